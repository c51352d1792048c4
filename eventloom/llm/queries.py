"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import topk, urls
from .html import op10_html_extraction
from .language import op1_language_id
from .mixing import op9_source_mixing
from .packing import op4_best_fit_packing
from .quality import op5_quality_rules
from .secrets import op7_secret_scan
from .separators import op3_token_counts
from .simhash import op8_simhash_near_dedup
from .topk import op2_topk_search
from .urls import op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_topk_search,
        op3_token_counts,
        op4_best_fit_packing,
        op5_quality_rules,
        op6_url_filter,
        op7_secret_scan,
        op8_simhash_near_dedup,
        op9_source_mixing,
        op10_html_extraction,
    )
}

ORACLES = {"op2_topk_search": topk.ORACLE, "op6_url_filter": urls.ORACLE}
