from collections import defaultdict

import pytest
from text_helpers import SMALL, found, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import line_rules, queries


def brute(text):
    w = found(text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if found(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        len(w) < 20 or 100 * len(covered) > 30 * len(w),
    )


def test_counts_of_whole_texts(spark, texts):
    got = queries.catalog.queries["op8_line_rules"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == brute(texts[r["doc_id"]]["text"])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("text", ["a " * 8, "a " * 9, "a b c d e f g h " * 2 + "z", "x\ny\nx\n \nx", "p q r s t u v w 1 p q r s t u v w 2 q r s t u v w 2 9"])
def test_repeats(spark, text):
    row = line_rules.measured(spark.createDataFrame([(text,)], "text string")).first()
    assert tuple(row)[1:] == brute(text)[:5]


def corpus(spark):
    own = lambda i: "\n".join(f"line {chr(97 + k)} of {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} with {chr(97 + k)} more words" for k in range(4))
    rows = [(i, "h", own(i) + "\nAll rights RESERVED 2024. ") for i in range(30)]
    rows += [(100 + i, "h", rows[0][2]) for i in range(20)]  # copies count once
    rows += [(200, "h", "\n".join(["all rights reserved 2025."] * 9)), (300, None, rows[1][2])]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_shared_lines_go_and_depleted_documents_too(spark):
    df = corpus(spark)
    got = {r["doc_id"]: r for r in line_rules.judge(df).collect()}
    assert got[1]["n_removed_chars"] == 25 and got[1]["kept"]
    assert got[0]["n_removed_chars"] == 0 == got[105]["n_removed_chars"]  # the first document that has it, and its copies
    assert got[200]["n_removed_chars"] == 9 * 25 and not got[200]["kept"]
    assert got[300]["n_removed_chars"] == 0  # another host
    out = {r["doc_id"]: r["text"] for r in line_rules.cleaned(df).collect()}
    assert "RESERVED" not in out[1] and "RESERVED" in out[0] and "RESERVED" in out[300] and 200 not in out
    assert out[1].count("\n") == 3


def test_odd_rows(odd, none):
    got = line_rules.judge(odd).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3, 4, 5, 6, 7] and not any(r["kept"] for r in got)
    assert line_rules.cleaned(odd).columns == odd.columns and line_rules.cleaned(none).count() == 0 == line_rules.judge(none).count()


def test_a_line_count_decides_alike_on_large_hosts(spark):
    own = "concat('own text number ', id, case when id % 1200 = 5 then '\nshared licence line' else '' end)"
    df = spark.range(13_000).selectExpr("id as doc_id", "'h' as source", own + " as text")
    df = df.withColumn("text", line_rules.F.translate("text", "0123456789", "abcdefghij"))
    lost = line_rules.shared_lines(df).collect()
    assert len(lost) == 10 and {r["chars"] for r in lost} == {len("shared licence line")}
