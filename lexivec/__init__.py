"""lexivec: distributional word and phrase vectors as Spark DataFrame jobs.

Layout
------
sources/    readers (vector TSV, instances, CoNLL, sentence corpora, GloVe text,
            line-aligned output, parquet stores) and the driver-table views
sinks/      writers (sparse TSV, dense parquet, triples, models, tensors, stages)
functions/  column expressions: feature grammar, PoS handling, dense vector algebra
operators/  counting, PPMI, composition, tensors, regression, neighbours,
            feature selection, embedding training, cleaning
plans/      end-to-end pipelines with stage materialisation
"""

from lexivec.session import ensure_checkpoint_dir, ensure_package, get_session

__all__ = ["get_session", "ensure_checkpoint_dir", "ensure_package"]
