"""Registered corpus queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from auditlake.llm import core, dropout, forest, langid, lm, nearcopies, packing, quality, rans, repeats, resharding


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        core.ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    name: _shipped(f)
    for name, f in {
        "op1_quality_rules": quality.query,
        "op2_rans_blocks": rans.query,
        "op3_packing": packing.query,
        "op4_fm_repeats": repeats.query,
        "op5_resharding": resharding.query,
        "op6_attention_lm": lm.query,
        "op7_projection_forest": forest.query,
        "op8_merge_dropout": dropout.query,
        "op9_language_id": langid.query,
        "op10_chosen_path_join": nearcopies.query,
        "pipeline": pipeline,
    }.items()
}

#: None of these has SQL: trained models, binary coding, linear programs, suffix indexes and seeded searches; their tests compare
#: them with brute force, exact round trips or held-out labels.
ORACLE: dict[str, str] = {}
