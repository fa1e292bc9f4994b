"""The subpackage's queries, by the names that __spark_entry__ registers, and their SQL where SQL can express them."""

from __future__ import annotations

from docweave.llm.avi import op4_avi_mjpeg
from docweave.llm.langid import op10_byte_bigru
from docweave.llm.linedup import OP8_SQL, op8_line_runs
from docweave.llm.mixing import op6_subset_sum_mix
from docweave.llm.neighbours import op3_kmeans_tree
from docweave.llm.pieces import op1_sentencepiece
from docweave.llm.sharding import op5_lpt_shards
from docweave.llm.simhash import op2_simhash_bk
from docweave.llm.substrings import op9_bucket_refinement
from docweave.llm.toxicity import op7_boosted_trees

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash_bk": op2_simhash_bk,
    "op3_kmeans_tree": op3_kmeans_tree,
    "op4_avi_mjpeg": op4_avi_mjpeg,
    "op5_lpt_shards": op5_lpt_shards,
    "op6_subset_sum_mix": op6_subset_sum_mix,
    "op7_boosted_trees": op7_boosted_trees,
    "op8_line_runs": op8_line_runs,
    "op9_bucket_refinement": op9_bucket_refinement,
    "op10_byte_bigru": op10_byte_bigru,
}

ORACLES = {
    "op8_line_runs": OP8_SQL,
}
