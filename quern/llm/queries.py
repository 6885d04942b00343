"""Registered queries of this subpackage."""

from quern.llm import chat, near_dedup, sort_count, tiered, topk
from quern.llm.chat import op6_chat
from quern.llm.cost_packing import op13_cost_packing
from quern.llm.html_text import op8_html
from quern.llm.language import op3_language
from quern.llm.mixing import op9_mixing
from quern.llm.near_dedup import op4_near_dedup
from quern.llm.packing import op10_best_fit_packing
from quern.llm.quality import op7_quality
from quern.llm.sort_count import op11_resampling
from quern.llm.spotsigs import op2_spotsigs
from quern.llm.tiered import op12_tiered_search
from quern.llm.topk import op5_topk
from quern.llm.urls import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_spotsigs, op3_language, op4_near_dedup, op5_topk, op6_chat, op7_quality, op8_html, op9_mixing, op10_best_fit_packing,
        op11_resampling, op12_tiered_search, op13_cost_packing,
    )
}
ORACLES: dict[str, str] = {
    "op4_near_dedup": near_dedup.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL, "op6_chat": chat.oracle_sql(), "op11_resampling": sort_count.ORACLE_SQL,
    "op12_tiered_search": tiered.ORACLE_SQL,
}
