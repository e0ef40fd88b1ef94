import os
import re

from recordloom.sources.inventory import INVENTORY

DOCUMENT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")


def test_contracts_match_the_fixture_schemas():
    with open(DOCUMENT, encoding="utf-8") as handle:
        sections = re.split(r"^## ", handle.read(), flags=re.M)
    seen = 0
    for section in sections:
        heading = re.match(r"([a-z-]+) — (\d+) columns", section)
        if not heading:
            continue
        contract, body = INVENTORY.require(heading[1]), section.partition("\n")[2]
        listed, _, rest = body.partition("Row floor")
        if "No candidate" in listed or "No uniqueness" in listed:
            listed = re.split(r"No (?:candidate|uniqueness)", listed)[0]
        names = [item.split()[0] for item in listed.replace("\n", " ").strip(" .").split(", ") if item.strip()]
        assert tuple(names) == contract.public_fields and len(names) == int(heading[2])
        assert int(rest.split()[0].strip(".").replace(",", "")) == contract.expected_minimum_rows
        seen += 1
    assert seen == len(INVENTORY)
