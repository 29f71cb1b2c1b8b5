"""Records read by byte ranges: every border, odd texts, tasks."""

import gzip
import io
import json
import random
import re

import pytest

from strata.sources import ranges, readers

TREC = re.compile(b"</DOC>")
JSON = re.compile(readers.JSON_RECORD.encode())


def all_ranges(data, size, pattern, at_match, chunk):
    found = []
    for start in range(0, len(data), size):
        found += ranges.records(io.BytesIO(data), start, min(start + size, len(data)), pattern, at_match, chunk)
    return found


def plainly(data, pattern, at_match):
    cuts = [m.start() if at_match else m.end() for m in pattern.finditer(data)]
    cuts = cuts if at_match else [0, *cuts]
    parts = [data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)])]
    return [p for p in parts if p]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
@pytest.mark.parametrize("start_bytes", [8, 256])
def test_records_across_every_border(monkeypatch, chunk, start_bytes):
    monkeypatch.setattr(ranges, "START_BYTES", start_bytes)
    rng = random.Random(chunk)
    for _ in range(12):
        parts = [rng.choice(["<DOC>é", "</DOC>", "x", "\n", "</DO", "C>", "</DOC></DOC>"]) for _ in range(rng.randint(0, 25))]
        data = "".join(parts).encode()
        want = plainly(data, TREC, False)
        for size in range(1, len(data) + 2):
            assert all_ranges(data, size, TREC, False, chunk) == want, (data, size)


def test_json_records_across_every_border():
    rows = [{"id": "a", "contents": 'tricky {"id": "x"} \\" ]'}, {"id": "b", "contents": ""}, {"contents": "é, {", "id": "c"}]
    for text in (json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False), "[]", ""):
        data = text.encode()
        want = plainly(data, JSON, True)
        for size in range(1, len(data) + 2):
            assert all_ranges(data, size, JSON, True, 16) == want
        if want:
            assert [json.loads(w.rstrip(b" \n,]")) for w in want] == rows


def test_one_misnamed_file_in_many_tasks(spark, tmp_path):
    folder = tmp_path / "2022-06_fr"
    folder.mkdir()
    texts = {f"doc{i}": f"text {i} é " * (i % 7 + 1) for i in range(300)}
    body = "".join(f"<DOC>\n<DOCNO>{i}</DOCNO>\n<TEXT>{t}</TEXT>\n</DOC>\n" for i, t in texts.items())
    (folder / "part.jsonl.gz").write_text(body, encoding="utf-8")
    (folder / "empty.jsonl.gz").write_text("")
    (folder / "other.txt").write_bytes(gzip.compress(b"x"))
    got = readers.trec_documents_misnamed(spark, str(tmp_path), range_bytes=len(body.encode()) // 6)
    rows = got.collect()
    assert got.rdd.getNumPartitions() >= 4
    assert {r.docid: r.contents for r in rows} == {i: t.strip() for i, t in texts.items()}
    assert len(rows) == 300 and {r.date for r in rows} == {"2022-06"}
    assert readers.trec_documents_misnamed(spark, str(tmp_path), "*.none").count() == 0


def test_arrays_of_any_size(spark, tmp_path):
    rows = [{"id": f"d{i}", "contents": f'text, "quoted" {{"id": 3}} ] {i}'} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "urls.json").write_text(json.dumps(rows))
    got = readers.json_array_documents(spark, str(tmp_path), range_bytes=1000)
    assert got.rdd.getNumPartitions() >= 4
    found = sorted((r.start, r.pos, r.docid, r.contents) for r in got.collect())
    assert [(i, c) for _, _, i, c in found] == [(r["id"], r["contents"]) for r in rows]
    first = readers.dev_sample(spark, str(tmp_path), 3).orderBy("pos").collect()
    assert [(r.pos, r.docid) for r in first] == [(0, "d0"), (1, "d1"), (2, "d2")]


def test_tasks_do_not_get_the_list_of_files(spark, tmp_path):
    """A release of very many files: listed without a driver call for each, planned once, left out of the tasks."""
    import pickle

    (tmp_path / "a").mkdir()
    for i in range(300):
        (tmp_path / "a" / f"part-{i:04d}.txt").write_text(json.dumps([{"id": f"d{i}-{j}", "contents": "x"} for j in range(4)]))
    (tmp_path / "a" / "_SUCCESS").write_text("x")
    (tmp_path / "a" / "empty.txt").write_text("")
    found = ranges.files(spark, str(tmp_path), "*.txt")
    assert [p.rsplit("/", 1)[1] for p, _ in found] == [f"part-{i:04d}.txt" for i in range(300)]
    options = dict(files=json.dumps(found), pattern="x", at_match="true", range_bytes="1000", most="3", tasks="4")
    reader = ranges.RangeReader(options)
    assert sum(len(p.parts) for p in reader.partitions()) == 300
    assert len(pickle.dumps(reader)) < 1000
    rows = readers.dev_sample(spark, str(tmp_path), 3, "*.txt")
    assert rows.count() == 900 and rows.where("pos > 2").isEmpty()
