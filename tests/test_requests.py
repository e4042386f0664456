"""The command-line rule cases of the reference as request rows."""

from pyspark.sql import functions as F

from docweave.operators import requests as R

COLS = ["doc_id", "use_model", "sentences", "effort", "output_format", "target", "desc_level", "sum_level"]


def _req(spark, rows):
    full = [(i,) + r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, R.REQUEST_SCHEMA)


def test_validation_order(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    cases = [
        ((9, False, None, None, None, None, None, None), "File not found: 9"),
        ((1, False, 3, None, None, None, None, None), "sentences requires use_model"),
        ((1, True, 0, None, None, None, None, None), "Sentences cannot be less than 1 and more than 250! Current amount: 0"),
        ((1, True, -5, None, None, None, None, None), "Current amount: -5"),
        ((1, True, 251, None, None, None, None, None), "Current amount: 251"),
        ((1, True, 5, None, None, None, None, None), None),
        ((1, False, None, "low", None, None, None, None), "effort requires use_model"),
        ((1, False, None, None, None, "out.md", None, None), "target requires use_model"),
        ((1, False, None, None, "md", None, None, None), "output_format requires use_model"),
        ((1, False, None, None, "txt", None, None, None), None),
        ((1, False, None, None, None, None, 2, None), "desc_level requires use_model"),
        ((1, False, None, None, None, None, 0, None), "Description level must be between 1 and 3. Got: 0"),
        ((1, True, None, None, None, None, 4, None), "Description level must be between 1 and 3. Got: 4"),
        ((1, False, None, None, None, None, None, 3), "sum_level requires use_model"),
        ((1, True, None, None, None, None, 1, 9), "Summary level must be between 1 and 3. Got: 9"),
        ((1, True, 250, "high", "json", "x.json", 3, 3), None),
        ((1, False, None, None, None, None, None, None), None),
        ((1, True, None, "max", None, None, None, None), "invalid effort value: 'max'"),
        ((1, True, None, None, "pdf", None, None, None), "invalid output_format value: 'pdf'"),
        ((9, False, 3, "max", None, None, None, None), "invalid effort value"),  # P2 first
    ]
    out = R.validate_requests(_req(spark, [c[0] for c in cases]), docs).orderBy("req_id").collect()
    for (row, want), got in zip(cases, out):
        if want is None:
            assert got.error is None and got.error_class is None, (row, got.error)
        else:
            assert got.error is not None and want in got.error, (row, got.error)


def test_resolve_options_precedence(spark):
    req = _req(spark, [(1, True, None, None, None, None, None, None),
                       (1, True, 7, "high", "md", None, 1, 3)])
    got = R.resolve_levels(R.resolve_options(req)).orderBy("req_id").collect()
    assert (got[0].model, got[0].sentences, got[0].output_format, got[0].desc_level, got[0].sum_level,
            got[0].max_retries) == ("gemini-2.5-flash", 5, "txt", 2, 2, 3)
    assert (got[1].model, got[1].sentences, got[1].output_format) == ("gemini-2.5-pro", 7, "md")
    assert got[1].desc_instruction == R.DESCRIPTION_LEVELS[1]
    assert got[1].sum_instruction == R.SUMMARY_LEVELS[3]
    cfg = R.resolve_options(req, {"model": "custom-model", "max_retries": 5, "sentences": 9}) \
        .orderBy("req_id").collect()
    assert (cfg[0].model, cfg[0].max_retries, cfg[0].sentences) == ("custom-model", 5, 9)
    assert cfg[1].model == "gemini-2.5-pro"  # explicit effort wins over config


def test_unknown_level_falls_back_to_level_2(spark):
    df = spark.createDataFrame([(7,), (None,)], "lv int")
    got = df.select(R.level_instruction(F.col("lv"), R.SUMMARY_LEVELS).alias("i")).collect()
    assert {r.i for r in got} == {R.SUMMARY_LEVELS[2]}


def test_effort_map_covers_efforts():
    assert set(R.EFFORT_TO_MODEL) == set(R.EFFORTS)
    assert R.EFFORT_TO_MODEL[R.DEFAULT_EFFORT] == "gemini-2.5-flash"


def test_config_from_session(spark):
    spark.conf.set("spark.docweave.model", "custom-model")
    spark.conf.set("spark.docweave.maxRetries", "5")
    try:
        cfg = R.config_from_session(spark)
        assert cfg == {"model": "custom-model", "max_retries": 5}
        req = _req(spark, [(1, True, None, None, None, None, None, None),
                           (1, True, None, "low", None, None, None, None)])
        got = R.resolve_options(req, cfg).orderBy("req_id").collect()
        assert (got[0].model, got[0].max_retries) == ("custom-model", 5)
        assert got[1].model == "gemini-2.5-flash-lite"
    finally:
        spark.conf.unset("spark.docweave.model")
        spark.conf.unset("spark.docweave.maxRetries")
    assert R.config_from_session(spark) == {}
