"""The numbered queries and the SQL that some of them can be held against."""

from __future__ import annotations

from fathom.llm.byte_bpe import byte_bpe
from fathom.llm.chat import chat
from fathom.llm.clustering import SQL as OP12_SQL
from fathom.llm.clustering import clustering
from fathom.llm.decontaminate import SQL as OP8_SQL
from fathom.llm.decontaminate import decontaminate
from fathom.llm.filter_audit import SQL as OP13_SQL
from fathom.llm.filter_audit import filter_audit
from fathom.llm.language_id import language_id
from fathom.llm.licenses import licenses
from fathom.llm.neardup import neardup
from fathom.llm.packed_ids import packed_ids
from fathom.llm.packing import packing
from fathom.llm.quality_model import quality_model
from fathom.llm.quality_rules import SQL as OP5_SQL
from fathom.llm.quality_rules import quality_rules
from fathom.llm.warc import warc


def queries() -> dict:
    return {"op1_warc": warc, "op2_language_id": language_id, "op3_packed_ids": packed_ids, "op4_packing": packing, "op5_quality_rules": quality_rules, "op6_licenses": licenses, "op7_chat": chat, "op8_decontaminate": decontaminate, "op9_neardup": neardup, "op10_quality_model": quality_model, "op11_byte_bpe": byte_bpe, "op12_clustering": clustering, "op13_filter_audit": filter_audit}


def oracle_sql() -> dict:
    return {"op5_quality_rules": OP5_SQL, "op8_decontaminate": OP8_SQL, "op12_clustering": OP12_SQL, "op13_filter_audit": OP13_SQL}
