"""Row count and amount of one resolved organization on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import strip
from recordloom.functions.values import AMOUNT_TYPE, parse_amount
from recordloom.plans.candidates import Source


def _side(source: Source, side: str, names: Sequence[str], extra: Column) -> DataFrame:
    contract = source.contract
    rows = source.df.where(strip(F.col(contract.name_field)).isin(list(names)) & extra)
    amount = F.lit(None).cast(AMOUNT_TYPE)
    if contract.candidate_amount:
        amount = F.coalesce(F.sum(parse_amount(F.col(contract.candidate_amount))), F.lit(0))
    return rows.groupBy().agg(
        F.count("*").alias("rows"), amount.cast(AMOUNT_TYPE).alias("amount")
    ).select(F.lit(side).alias("side"), F.lit(contract.slug).alias("source"), "rows", "amount")


def organization_card(
    campaign: Source, public: Source, campaign_names: Sequence[str], public_names: Sequence[str], code: str
) -> DataFrame:
    """(side, source, rows, amount) over the rows one candidate pair's links point to."""
    types = [v.lower() for v in campaign.contract.type_values]
    typed = F.lower(strip(F.col(campaign.contract.type_field))).isin(types)
    coded = F.lit(True)
    if public.contract.code_field:
        coded = strip(F.coalesce(F.col(public.contract.code_field), F.lit(""))) == code
    left = _side(campaign, "campaign", campaign_names, typed)
    return left.unionByName(_side(public, "public", public_names, coded))
