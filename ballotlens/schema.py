"""Table layouts: typed schemas, the proposal header mapping and column aliases."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: proposal fields as (table column, header in the source file, kind).
# kind: int (blank / -1 -> NULL), str (blank -> NULL), date (six layouts),
# dirname (blank / -1 -> NULL), float, bool.
PROPOSAL_FIELDS: tuple[tuple[str, str, str], ...] = (
    ("proposal_master_skey", "proposal_master_skey", "int"),
    ("director_master_skey", "director_master_skey", "int"),
    ("final_key", "final_key", "str"),
    ("job_number", "job_number", "str"),
    ("issuer_name", "issuer_name", "str"),
    ("service", "service", "str"),
    ("cusip6", "cusip6", "str"),
    ("mt_date", "mt_date", "date"),
    ("ml_date", "ml_date", "date"),
    ("record_date", "record_date", "date"),
    ("mgmt_rec", "mgmt_rec", "str"),
    ("proposal", "proposal", "str"),
    ("proposal_type", "proposal_type", "str"),
    ("director_number", "director_number", "int"),
    ("director_name", "director_name", "dirname"),
    ("category", "Category", "str"),
    ("subcategory", "Subcategory", "str"),
    ("predicted_for_shares", "predicted_for_shares", "int"),
    ("predicted_against_shares", "predicted_against_shares", "int"),
    ("predicted_abstain_shares", "predicted_abstain_shares", "int"),
    ("predicted_unvoted_shares", "predicted_unvoted_shares", "int"),
    ("total_for_shares", "total_for_shares", "int"),
    ("total_against_shares", "total_against_shares", "int"),
    ("total_abstain_shares", "total_abstain_shares", "int"),
    ("total_unvoted_shares", "total_unvoted_shares", "int"),
    ("for_ratio_among_voted", "ForRatioAmongVoted", "float"),
    ("for_ratio_among_elig", "ForRatioAmongElig", "float"),
    ("voting_ratio", "VotingRatio", "float"),
    ("for_ratio_among_voted_true", "ForRatioAmongVoted_true", "float"),
    ("for_ratio_among_elig_true", "ForRatioAmongElig_true", "float"),
    ("voting_ratio_true", "VotingRatio_true", "float"),
    ("for_ratio_among_voted_incl_abs", "ForRatioAmongVotedInclAbs", "float"),
    ("for_ratio_among_elig_incl_abs", "ForRatioAmongEligInclAbs", "float"),
    ("voting_ratio_incl_abs", "VotingRatioInclAbs", "float"),
    ("for_ratio_among_voted_incl_abs_true", "ForRatioAmongVotedInclAbs_true", "float"),
    ("for_ratio_among_elig_incl_abs_true", "ForRatioAmongEligInclAbs_true", "float"),
    ("voting_ratio_incl_abs_true", "VotingRatioInclAbs_true", "float"),
    ("for_percentage", "For %", "float"),
    ("against_percentage", "Against %", "float"),
    ("abstain_percentage", "Abstain %", "float"),
    ("for_percentage_true", "For % True", "float"),
    ("against_percentage_true", "Against % True", "float"),
    ("abstain_percentage_true", "Abstain % True", "float"),
    ("prediction_correct", "prediction_correct", "bool"),
    ("approved", "approved", "bool"),
    ("for_prospectus_2026", "For (%) - From Prospectus 2026 File", "float"),
    ("against_prospectus_2026", "Against (%) - From Prospectus 2026 File", "str"),
    ("abstain_prospectus_2026", "Abstain/Withhold (%) - From Prospectus 2026 File", "str"),
)

# fixed values: alternative source names of account columns, first present wins
ACCOUNT_ALIASES: dict[str, tuple[str, ...]] = {
    "score_model2": ("score_model1", "score", "score_model", "calibrated_score"),
    "prediction_model2": ("prediction_model1", "prediction", "prediction_model", "calibrated_prediction"),
    "Target_encoded": ("true_outcome", "target", "outcome", "Target"),
}

# fixed values: account file columns in order (current layout) and the old extra ones
ACCOUNT_FILE_COLUMNS = ("account_hash_key", "proposal_master_skey", "director_master_skey", "account_type",
                        "shares_summable", "rank_of_shareholding", "score_model1", "prediction_model1",
                        "Target_encoded")
OLD_FORMAT_COLUMNS = ("row_index", "unnamed_col")
ACCOUNT_TYPES = ("Individual", "Institution", "Mutual Fund", "Other")

# fixed values: declared VARCHAR lengths of proposal text columns
VARCHAR_LIMITS = {"final_key": 1000, "job_number": 50, "issuer_name": 200, "service": 50, "cusip6": 50,
                  "mgmt_rec": 50, "proposal_type": 50, "director_name": 50, "category": 50,
                  "subcategory": 50, "against_prospectus_2026": 50, "abstain_prospectus_2026": 50}

_KIND_TYPE = {"int": T.LongType(), "str": T.StringType(), "date": T.DateType(), "dirname": T.StringType(),
              "float": T.DoubleType(), "bool": T.BooleanType()}

PROPOSALS_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(name, _KIND_TYPE[kind], True) for name, _, kind in PROPOSAL_FIELDS]
    + [T.StructField("created_at", T.TimestampType(), True)]
)

ACCOUNTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("account_hash_key", T.StringType(), True),
    T.StructField("proposal_master_skey", T.LongType(), True),
    T.StructField("director_master_skey", T.LongType(), True),
    T.StructField("account_type", T.StringType(), True),
    T.StructField("shares_summable", T.DecimalType(20, 4), True),
    T.StructField("rank_of_shareholding", T.LongType(), True),
    T.StructField("score_model2", T.DecimalType(20, 15), True),
    T.StructField("prediction_model2", T.DecimalType(10, 6), True),
    T.StructField("Target_encoded", T.LongType(), True),
    T.StructField("is_voted", T.IntegerType(), True),
    T.StructField("dataset", T.StringType(), True),
])

# fixed values: the narrow proposal file's fields as (column, kind).
# kind: key (whole number, anything else fails the row), text, text500 (first
# 500 characters), flag (blank: false; not a whole number fails the row), num6 /
# num4 (rounded to so many places), date (three layouts).
NARROW_FIELDS: tuple[tuple[str, str], ...] = (
    ("proposal_master_skey", "key"), ("director_master_skey", "key"), ("issuer_name", "text500"),
    ("category", "text500"), ("proposal", "text"), ("prediction_correct", "flag"), ("approved", "flag"),
    ("for_percentage", "num6"), ("against_percentage", "num6"), ("abstain_percentage", "num6"),
    ("predicted_for_shares", "num4"), ("predicted_against_shares", "num4"), ("predicted_abstain_shares", "num4"),
    ("predicted_unvoted_shares", "num4"), ("total_for_shares", "num4"), ("total_against_shares", "num4"),
    ("total_abstain_shares", "num4"), ("total_unvoted_shares", "num4"), ("meeting_date", "date"),
)

# fixed values: types of the 11 outreach columns
OUTREACH_TYPES = {"row_index": "bigint", "unnamed_col": "string", "account_hash_key": "string",
                  "proposal_master_skey": "bigint", "director_master_skey": "bigint", "account_type": "string",
                  "shares_summable": "double", "rank_of_shareholding": "bigint", "score_model1": "double",
                  "prediction_model1": "int", "Target_encoded": "bigint"}

# fixed values: checks of the upload validator: column -> expected kind (int / float / string / bool / date)
ACCOUNT_CHECKS = {"row_index": "int", "unnamed_col": "string", "account_hash_key": "string",
                  "proposal_master_skey": "int", "director_master_skey": "int", "account_type": "string",
                  "shares_summable": "float", "rank_of_shareholding": "int", "score_model1": "float",
                  "prediction_model1": "int", "Target_encoded": "int"}
