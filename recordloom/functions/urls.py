"""Row-level links back to the publisher, and checks on evidence links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import strip

# The row-query dialect of the publishing portal.
ROW_LIMIT = "50000"


def percent_encode(value: Column) -> Column:
    """Percent-encode everything but unreserved characters."""
    encoded = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def query_literal(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def in_clause(field: str, values: Column) -> Column:
    """``field = 'x'`` for one value, ``field in ('x', 'y')`` for more; null for none."""
    literals = F.transform(F.array_sort(F.array_distinct(values)), query_literal)
    return (
        F.when(F.size(literals) == 1, F.concat(F.lit(f"{field} = "), literals[0]))
        .when(
            F.size(literals) > 1,
            F.concat(F.lit(f"{field} in ("), F.array_join(literals, ", "), F.lit(")")),
        )
    )


def source_rows_url(
    portal: str, dataset_id: str, public_fields: Sequence[str], filters: Sequence[tuple[str, Column]]
) -> Column:
    """Link to the published rows whose fields take the given values (arrays of strings).

    Only public fields may appear in a filter.
    """
    private = [field for field, _ in filters if field not in public_fields]
    if private:
        raise ValueError(f"row filter on fields that are not public: {', '.join(private)}")
    where = F.concat_ws(" AND ", *[in_clause(field, values) for field, values in filters])
    return F.concat(
        F.lit(f"{portal}/resource/{dataset_id}.json?%24select="),
        percent_encode(F.lit(",".join(public_fields))),
        F.lit("&%24where="),
        percent_encode(where),
        F.lit(f"&%24limit={ROW_LIMIT}"),
    )


def _is_https(url: Column) -> Column:
    host = F.regexp_extract(F.translate(url, "\t\r\n", ""), r"^(?i:https)://([^/?#]*)", 1)
    user = F.when(host.contains("@"), F.regexp_replace(host, "@[^@]*$", "")).otherwise("")
    brackets = host.rlike(r"^[^\[\]]*$") | host.rlike(r"^(?:[^\[\]]*@)?\[[0-9A-Fa-f:.]+\](?::\d*)?$")
    return (host != "") & user.isin("", ":") & brackets


def valid_evidence_urls(value: Column) -> Column:
    """Every ``|``-separated part is an HTTPS link with a host and no user information."""
    return F.forall(F.split(value, r"\|"), lambda part: _is_https(strip(part)))
