"""Sample tables to hand out, made from real rows.

Hash keys and names become salted digests, amounts are coarsened; keys that
join, types, ranks and predictions stay, so every report still works.  A row
depends on itself and the salt alone: any partitioning, any re-run of a lost
task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pseudonym(c: Column | str, salt: str, length: int = 24) -> Column:
    """The first hex digits of a salted SHA-256; NULL stays NULL."""
    x = F.col(c) if isinstance(c, str) else c
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), x.cast("string")), 256), 1, length)


def sample_accounts(accounts: DataFrame, salt: str, unit: int = 100) -> DataFrame:
    """Account rows with pseudonyms for hash keys and shares in whole ``unit``s."""
    shares = (F.floor(F.col("shares_summable") / unit) * unit).cast("bigint")
    return accounts.withColumns({"account_hash_key": pseudonym("account_hash_key", salt), "shares_summable": shares})


def sample_proposals(proposals: DataFrame, salt: str) -> DataFrame:
    """Proposal rows whose issuers (one pseudonym for all spellings that the
    server takes for one), texts and final keys are replaced."""
    issuer = F.concat(F.lit("Issuer "), pseudonym(F.lower(F.rtrim("issuer_name")), salt, 8))
    return proposals.withColumns({"issuer_name": issuer, "final_key": pseudonym("final_key", salt, 12),
                                  "proposal": F.concat(F.lit("Proposal "), F.col("id").cast("string"))})
