"""Property test: T1-T6 equal the plain-Python rules on generated text."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docweave.functions import text as T
from tests.test_text import lead, one_spaced, sentences, summary

ALPHABET = st.sampled_from(list("ab .!?,\n\t\r") + ["\xa0", " ", "\x1c", "\x85", "　",
                                                     "é", "\U0001F600", "3", "x"])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=40)


@settings(max_examples=25, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_text_rules_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("id", T.normalize_whitespace("t").alias("n"), T.split_sentences("t").alias("s"),
                     T.lead_summary("t", 2).alias("l"), T.local_summary("t", size=7).alias("c")).collect()
    for r in rows:
        t = texts[r.id]
        assert r.n == one_spaced(t)
        assert r.s == sentences(t)
        assert r.l == lead(t, 2)
        assert r.c == summary(t, size=7)
