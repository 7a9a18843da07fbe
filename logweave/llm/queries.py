"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from .decontam import OP4_SQL, op4_decontam
from .dialogues import op13_dialogues
from .langid import op8_langid
from .licenses import op1_licenses
from .linededup import op5_line_dedup
from .mixing import OP10_SQL, op10_mix
from .neardup import op2_ngram_join
from .pages import op11_html_text
from .phrases import OP12_SQL, op12_collocations
from .secrets import OP6_SQL, op6_secrets
from .substrings import op3_suffix_dedup
from .tokens import op9_tokens
from .topk import OP7_SQL, op7_topk

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontam": op4_decontam,
    "op5_line_dedup": op5_line_dedup,
    "op6_secrets": op6_secrets,
    "op7_topk": op7_topk,
    "op8_langid": op8_langid,
    "op9_tokens": op9_tokens,
    "op10_mix": op10_mix,
    "op11_html_text": op11_html_text,
    "op12_collocations": op12_collocations,
    "op13_dialogues": op13_dialogues,
}
SQL = {
    "op4_decontam": OP4_SQL,
    "op6_secrets": OP6_SQL,
    "op7_topk": OP7_SQL,
    "op10_mix": OP10_SQL,
    "op12_collocations": OP12_SQL,
}
