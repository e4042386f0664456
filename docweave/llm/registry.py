"""Queries and DuckDB oracles of this folder, by name."""

from __future__ import annotations

from docweave.llm.bpe import op1_bpe
from docweave.llm.clustering import ORACLE as CLUSTERS_SQL
from docweave.llm.clustering import op12_clusters
from docweave.llm.decontaminate import ORACLE as DECONTAMINATE_SQL
from docweave.llm.decontaminate import op13_decontaminate
from docweave.llm.divergence import ORACLE as DIVERGENCE_SQL
from docweave.llm.divergence import op11_divergence
from docweave.llm.language_model import op10_language_model
from docweave.llm.lines import ORACLE as LINES_SQL
from docweave.llm.lines import op3_lines
from docweave.llm.minhash import op6_minhash
from docweave.llm.mixing import op7_mixing
from docweave.llm.quality import op5_quality
from docweave.llm.secrets import op9_secrets
from docweave.llm.substrings import op4_substrings
from docweave.llm.topk import ORACLE as TOPK_SQL
from docweave.llm.topk import op8_topk
from docweave.llm.vectors import op2_vectors

QUERIES = {
    "op1_bpe": op1_bpe, "op2_vectors": op2_vectors, "op3_lines": op3_lines, "op4_substrings": op4_substrings, "op5_quality": op5_quality,
    "op6_minhash": op6_minhash, "op7_mixing": op7_mixing,
    "op8_topk": op8_topk, "op9_secrets": op9_secrets, "op10_language_model": op10_language_model,
    "op11_divergence": op11_divergence, "op12_clusters": op12_clusters, "op13_decontaminate": op13_decontaminate,
}
ORACLES: dict[str, str] = {"op3_lines": LINES_SQL, "op8_topk": TOPK_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_clusters": CLUSTERS_SQL, "op13_decontaminate": DECONTAMINATE_SQL}
