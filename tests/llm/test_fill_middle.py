import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from strata.llm import fill_middle as fim

TEXTS = [
    "", "\n", "one line", "a\nb\n", "a\nb", "\n\n\n", "é\n\U0001f600x\n\nend", "a <P> b\nc", "<S>", "x\n<M>\n",
    "<\nP>\n<\n", "tail <\n<S\n>", "line\r\nother\n\x00\n", " \n" * 500, "x" * 200_000 + "\ny", "a\x85b c\n",
]


def plainly(doc_id, text, draw=fim.Draw()):
    """The contract, read word by word."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{draw.seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= draw.transformed:
        return n, "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h4 % 100 < draw.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("step", [1, 3, fim.STEP])
def test_rotation_and_its_inverse(monkeypatch, step):
    monkeypatch.setattr(fim, "STEP", step)
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = rng.integers(0, 256, rng.integers(0, 40)).astype(np.uint8)
        a, b, c = sorted(rng.integers(0, len(data) + 1, 3).tolist())
        moved = data.copy()
        fim.rotate(moved, a, b, c)
        assert moved.tolist() == [*data[:a], *data[b:c], *data[a:b], *data[c:]]
        fim.rotate(moved, a, a + c - b, c)
        assert moved.tolist() == data.tolist()


def test_every_text_against_the_contract():
    seen = set()
    for text in TEXTS:
        for doc_id in range(60):
            made = fim.transform_text(doc_id, text.encode(), fim.Draw())
            n, form, p, m, output = plainly(doc_id, text)
            assert (made.lines, made.form, made.output.decode()) == (n, form, output)
            if form != "plain":
                assert (fim.points(made.prefix), fim.points(made.middle)) == (p, m)
            assert fim.restore_text(made.output, made.form).decode() == text
            seen.add(form)
    assert seen == {"plain", "psm", "spm"}


def test_shares_of_forms():
    text, draw = b"a\nb\nc\n", fim.Draw(seed=3, transformed=40, spm=25)
    forms = [fim.transform_text(i, text, draw).form for i in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.6) < 0.03
    assert abs(forms.count("spm") / 4000 - 0.1) < 0.02


def test_broken_outputs_are_refused():
    for output, form in ((b"no sentinels", "psm"), (b"<S>a<P>b<M>c", "psm"), (b"<P>a<S>b", "psm"), (b"x<S>a<P>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.restore_text(output, form)


def test_tables(spark):
    rows = [(i, t, "n", "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "other\ntext\n", None, "y"), (3, "a\nb\n", None, "y"), (70, None, None, None), (None, "a\nb\nc", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_text string, n string").repartition(3)
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    back = fim.restore(made).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.restored == (r.text or "")
        want = plainly("" if r.doc_id is None else r.doc_id, r.text or "")
        assert (r.fim_lines, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == want
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, fim.report(docs).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        n, form, p, m, output = plainly("" if doc_id is None else doc_id, text or "")
        want.append((doc_id, n, form, p, m, digest(output), digest(text or "")))
    assert got == sorted(want, key=str)
    assert fim.report(docs.limit(0)).count() == 0 and fim.transform(docs.limit(0)).count() == 0
    # The registered SQL says the same of these rows.
    documents = pd.DataFrame([(i, t) for i, t, *_ in rows if i is not None], columns=["doc_id", "text"])  # noqa: F841
    sql = duckdb.sql(fim.report_sql()).fetchall()
    assert sorted(sql, key=str) == [w for w in sorted(want, key=str) if w[0] is not None]


def test_restore_of_null_rows(spark):
    rows = spark.createDataFrame([(None, None), ("kept", None)], "fim_text string, fim_form string")
    assert sorted(map(str, (r.restored for r in fim.restore(rows).collect()))) == ["None", "kept"]
