"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from voxloom.llm.ann import op7_ann_search
from voxloom.llm.conversations import OP12_SQL, op12_conversation_repair
from voxloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from voxloom.llm.langid import op8_language_id
from voxloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from voxloom.llm.minhash import OP4_SQL, op4_minhash_near_dedup
from voxloom.llm.mixing import op9_mixing
from voxloom.llm.packing import op3_packing
from voxloom.llm.quality import op1_quality_classifier
from voxloom.llm.sharding import op5_sharding
from voxloom.llm.token_cache import op10_token_counts
from voxloom.llm.voronoi import OP11_SQL, op11_exact_topk


def queries() -> dict:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_line_dedup": op2_line_dedup,
        "op3_packing": op3_packing,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_sharding": op5_sharding,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_ann_search": op7_ann_search,
        "op8_language_id": op8_language_id,
        "op9_mixing": op9_mixing,
        "op10_token_counts": op10_token_counts,
        "op11_exact_topk": op11_exact_topk,
        "op12_conversation_repair": op12_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op4_minhash_near_dedup": OP4_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op11_exact_topk": OP11_SQL,
        "op12_conversation_repair": OP12_SQL,
    }
