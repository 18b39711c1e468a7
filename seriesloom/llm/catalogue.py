"""All queries of this subpackage, each with its SQL counterpart where SQL can say it."""

from seriesloom.llm import q_conversation_repair, q_exact_dedup, q_html_extraction, q_jaccard_join, q_language_id, q_license_scan, q_mixing, q_packing, q_quality_resampling, q_secret_scan, q_token_files, q_topk_search, q_whitening  # noqa: F401
from seriesloom.llm.base import QUERIES, SQL  # noqa: F401
