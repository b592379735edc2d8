"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op1_decontamination
from .jaccard import op5_jaccard
from .language import op9_language
from .licenses import OP2_SQL, op2_licenses
from .lm import op10_lm
from .mixing import OP6_SQL, op6_mixing
from .quality import op8_quality
from .secrets import op4_secrets
from .topk import OP3_SQL, op3_topk
from .warc import OP7_SQL, op7_warc


def queries() -> dict:
    found = [op1_decontamination, op2_licenses, op3_topk, op4_secrets, op5_jaccard, op6_mixing, op7_warc, op8_quality, op9_language, op10_lm]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": OP2_SQL, "op3_topk": OP3_SQL, "op6_mixing": OP6_SQL, "op7_warc": OP7_SQL}
