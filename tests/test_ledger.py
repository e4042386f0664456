"""The reply ledger: every prompt is paid for once, whatever dies in between."""

import json
import os
import subprocess
import sys
import textwrap

from docweave.operators import inference as M
from docweave.operators.ledger import ReplyLedger, TaskReplies
from docweave.plans.summarize import summarize

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROMPTS = "req_id long, prompt string, model string, max_retries int"


def counting(folder, behave=lambda prompt: f"reply to {prompt}"):
    """A provider that leaves a file for every call."""
    def factory():
        import uuid

        def call(prompt, model):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            return behave(prompt)
        return call
    return factory


def calls(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


CRASH = """
    import json, os, sys, uuid
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "2").getOrCreate())
    from docweave.operators import inference as M
    from docweave.operators.ledger import ReplyLedger

    def factory():
        made = []
        def call(prompt, model):
            if len(made) == 5:  # half way through its partition, once
                try:
                    os.close(os.open({flag!r}, os.O_CREAT | os.O_EXCL))
                    os._exit(1)
                except FileExistsError:
                    pass
            made.append(prompt)
            with open(os.path.join({calls!r}, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            return "reply to " + prompt
        return call

    df = spark.createDataFrame([(i, f"p{{i % 40}}", "m", 3) for i in range(60)], {schema!r})
    ledger = ReplyLedger({ledger!r})
    rows = M.infer_batch(df, factory, partitions=2, initial_delay=0.0, ledger=ledger).collect()
    print(json.dumps(sorted([r.req_id, r.content, r.status] for r in rows)))
"""


def test_a_task_that_dies_half_way_pays_once(spark, tmp_path):
    seen, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    seen.mkdir()
    script = textwrap.dedent(CRASH).format(root=ROOT, flag=str(tmp_path / "died"), calls=str(seen), ledger=ledger, schema=PROMPTS)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=str(tmp_path))
    assert done.returncode == 0, done.stderr[-3000:]
    rows = json.loads(done.stdout.splitlines()[-1])
    assert rows == [[i, f"reply to p{i % 40}", "ok"] for i in range(60)]
    assert (tmp_path / "died").exists()
    assert calls(seen) == sorted(f"p{i}" for i in range(40))  # each distinct prompt once

    # the driver is gone too; the next job finds what was never settled
    df = spark.createDataFrame([(i, f"p{i}", "m", 3) for i in range(41)], PROMPTS)
    book = ReplyLedger(ledger)
    out = M.infer_batch(df, counting(str(seen)), initial_delay=0.0, ledger=book).collect()
    assert {r.req_id: r.content for r in out} == {i: f"reply to p{i}" for i in range(41)}
    assert len(calls(seen)) == 41
    book.settle(spark, everything=True)
    assert not (tmp_path / "ledger" / "pending").exists()
    assert ReplyLedger(ledger).replies(spark).count() == 41


def test_second_actions_and_later_jobs(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()

    def behave(prompt):
        if prompt == "down":
            raise ConnectionError("no route")
        return "" if prompt == "mute" else "x é\ud83d" + prompt

    df = spark.createDataFrame([(1, "a", "m", 2), (2, "a", "m", 2), (3, "a", "other", 2), (4, "down", "m", 2), (5, "mute", "m", 2),
                                (6, None, "m", 2), (7, "b", None, 2)], PROMPTS)
    book = ReplyLedger(str(tmp_path / "ledger"))
    out = M.infer_batch(df, counting(str(seen), behave), initial_delay=0.0, ledger=book)
    first = sorted(map(tuple, out.collect()))
    assert first == sorted(map(tuple, out.collect()))  # a second action finds the first one's replies
    want = ["a", "a", "b", "down", "down", "mute"]
    assert calls(seen) == want
    by = {r[0]: r for r in first}
    assert by[1][1:] == by[2][1:] and by[1][2:4] == (1, M.OK) and by[5][3] == M.BAD_REPLY and by[4][3] == M.API_ERROR
    assert by[6] == (6, None, 0, M.BAD_REPLY, "no prompt") and by[7][3] == M.OK
    book.settle(spark)
    later = ReplyLedger(str(tmp_path / "ledger"))
    again = sorted(map(tuple, M.infer_batch(df, counting(str(seen), behave), initial_delay=0.0, ledger=later).collect()))
    assert again == first
    assert calls(seen) == sorted(want + ["down", "down"])  # what never answered is asked again, a blank reply is not


def test_config_errors_are_not_kept(spark, tmp_path):
    def broken():
        raise M.ProviderConfigError("API key is not set")

    df = spark.createDataFrame([(i, "p", "m", 3) for i in range(4)], PROMPTS)
    path = str(tmp_path / "ledger")
    out = M.infer_batch(df, broken, initial_delay=0.0, ledger=ReplyLedger(path)).collect()
    assert {(r.status, r.error, r.attempts) for r in out} == {(M.CONFIG_ERROR, "API key is not set", 0)}
    seen = tmp_path / "calls"
    seen.mkdir()
    out = M.infer_batch(df, counting(str(seen)), initial_delay=0.0, ledger=ReplyLedger(path)).collect()
    assert {r.status for r in out} == {M.OK} and calls(seen) == ["p"]


def test_flushing_every_few_replies(tmp_path):
    mine = TaskReplies(str(tmp_path), "job", 3, every=4)
    for i in range(10):
        mine.keep(f"k{i}", (f"r{i}", 1, "ok", None))
    (tmp_path / "job" / "3" / ".half.json.part").write_text("{")  # what a killed write leaves behind is not read
    assert set(TaskReplies(str(tmp_path), "job", 3).known) == {f"k{i}" for i in range(8)}
    mine.flush()
    assert TaskReplies(str(tmp_path), "job", 3).known["k9"] == ("r9", 1, "ok", None)
    assert TaskReplies(str(tmp_path), "job", 2).known == {}


def test_summarize_with_a_ledger(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    docs = spark.createDataFrame([(i, f"Text {i}. More.") for i in range(12)], "doc_id long, text string")
    req = spark.createDataFrame([(i, i % 13, i % 5 != 0, None, None, None, None, None, None) for i in range(60)],
                                "req_id long, doc_id long, use_model boolean, sentences int, effort string, "
                                "output_format string, target string, desc_level int, sum_level int")
    plain = summarize(req, docs, lambda: lambda p, m: "a summary", initial_delay=0.0)
    runs = [summarize(req, docs, counting(str(seen), lambda p: "a summary"), initial_delay=0.0, materialize=True,
                      ledger=ReplyLedger(str(tmp_path / "ledger"))) for _ in range(2)]
    want = sorted(map(tuple, plain.collect()))
    assert [sorted(map(tuple, r.collect())) for r in runs] == [want, want]
    assert len(calls(seen)) == 12
