"""Single-table and two-table operators. Most return a lazy DataFrame; those that write an intermediate table or count
violations while they are called say so: ``first_violations``, ``first_findings``, ``profile_fields``, ``checked_fixture``."""
