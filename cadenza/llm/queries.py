"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .fingerprints import op3_fingerprints
from .jaccard import OP1_SQL, op1_ngram_jaccard
from .licenses import op10_license_scan
from .mixing import op2_mixing
from .packing import op4_packing
from .quality import op6_quality_classifier
from .repeats import OP9_SQL, op9_substring_dedup
from .rules import OP7_SQL, op7_quality_rules
from .sharding import op8_sharding
from .warc import op5_warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_mixing, op3_fingerprints, op4_packing, op5_warc, op6_quality_classifier, op7_quality_rules, op8_sharding, op9_substring_dedup, op10_license_scan, pipeline)}
SQL = {"op1_ngram_jaccard": OP1_SQL, "op7_quality_rules": OP7_SQL, "op9_substring_dedup": OP9_SQL}
