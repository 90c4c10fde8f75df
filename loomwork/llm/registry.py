"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import clustering, exacttopk, linededup, secretscan
from loomwork.llm.clustering import op13_centroid_clusters
from loomwork.llm.decontaminate import op9_decontamination
from loomwork.llm.exacttopk import op12_exact_top_k
from loomwork.llm.htmltext import op3_html_text
from loomwork.llm.innerproduct import op4_nearest_neighbours
from loomwork.llm.langid import op7_language_id
from loomwork.llm.linededup import op10_line_dedup
from loomwork.llm.packing import op5_packing
from loomwork.llm.periodic import op11_periodic_runs
from loomwork.llm.secretscan import op6_secret_scan
from loomwork.llm.simhash import op1_simhash_neardup
from loomwork.llm.tokenstore import op8_token_store
from loomwork.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_token_store": op8_token_store,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op6_secret_scan": secretscan.SQL,
    "op10_line_dedup": linededup.SQL,
    "op12_exact_top_k": exacttopk.SQL,
    "op13_centroid_clusters": clustering.SQL,
}
