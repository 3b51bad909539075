"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .cover import OP8_SQL, op8_cover_tree
from .filter_audit import OP11_SQL, op11_filter_audit
from .langid import op9_language_id
from .mixing import OP1_SQL, op1_mixing
from .packing import op10_packing
from .pii import op5_pii
from .simhash import op7_simhash
from .tokens import op3_token_counts
from .topk import OP2_SQL, op2_topk
from .url_filter import OP4_SQL, op4_url_filters
from .warc import OP6_SQL, op6_warc
from .winnow import OP12_SQL, op12_decontamination

QUERIES = {"op1_mixing": op1_mixing, "op2_topk": op2_topk, "op3_token_counts": op3_token_counts, "op4_url_filters": op4_url_filters, "op5_pii": op5_pii, "op6_warc": op6_warc, "op7_simhash": op7_simhash, "op8_cover_tree": op8_cover_tree, "op9_language_id": op9_language_id, "op10_packing": op10_packing, "op11_filter_audit": op11_filter_audit, "op12_decontamination": op12_decontamination}
ORACLES = {"op1_mixing": OP1_SQL, "op8_cover_tree": OP8_SQL, "op2_topk": OP2_SQL, "op4_url_filters": OP4_SQL, "op6_warc": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_decontamination": OP12_SQL}
