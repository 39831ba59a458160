"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import decontaminate, licenses, mixing, neighbours, quality, secrets, sharding, simhash, suffixes, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_secrets": secrets.op7_secrets,
    "op8_licenses": licenses.op8_licenses,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {"op5_suffixes": suffixes.OP5_SQL, "op6_decontamination": decontaminate.OP6_SQL}
