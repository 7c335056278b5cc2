import gzip
import hashlib
import random

from quire.llm import warc


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(rows, per_file, top, fanout=warc.FANOUT):
    """Root of the same tree over records with distinct ids, built literally."""
    inside, n = 0, per_file
    while n > 1:
        inside, n = inside + 1, -(-n // fanout)
    nodes = {(0, i // per_file, i % per_file): (1, len(r.encode()), sha(r)) for i, r in rows}
    for level in range(top):
        groups = {}
        for key in sorted(nodes):
            kind, file, idx = key
            up = (kind, file, idx // fanout) if level < inside else (kind, file // fanout, 0) if level < top - 1 else (0, 0, 0)
            groups.setdefault(up, []).append((key, nodes[key]))
        nodes = {}
        for up, children in groups.items():
            text = ";".join(":".join(map(str, (*key, n, size, digest))) for key, (n, size, digest) in children)
            nodes[up] = (sum(c[0] for _, c in children), sum(c[1] for _, c in children), sha(text))
    assert len(nodes) == 1
    return nodes[0, 0, 0][2]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, record string")


def levels(spark, rows, per_file):
    leaf = warc.leaves(warc.digests(frame(spark, rows)), per_file)
    top = warc.height([leaf], per_file)
    return warc.tree(leaf, top, per_file), top


def brief(found):
    return sorted((r.page_id if r.page_id is not None else -99, r.status) for r in found.collect())


def test_tree_against_literal_build(spark):
    rng = random.Random(1)
    for n, per_file, low in ((1, 5, 0), (300, 40, -50), (700, 7, -3)):
        rows = [(i, f"record {i} {rng.random()}") for i in rng.sample(range(low, n * 2), n)]
        built, top = levels(spark, rows, per_file)
        assert built[-1].count() == 1 and warc.root_digest(built) == plain_root(rows, per_file, top)


def test_one_root_with_null_and_negative_ids(spark):
    rows = [(None, "a"), (None, "b"), (1, "c"), (20_000, "d"), (-1, "e"), (-20_000, "f"), (-(2**62), "g")]
    built, _ = levels(spark, rows, 1000)
    assert built[-1].count() == 1
    for k in range(len(rows)):  # any change changes the root
        other = [(i, r + "!" if j == k else r) for j, (i, r) in enumerate(rows)]
        assert warc.root_digest(levels(spark, other, 1000)[0]) != warc.root_digest(built)
    got = warc.audit(frame(spark, rows), frame(spark, [(i, r + "!" if i == -1 else r) for i, r in rows[1:]]))
    assert brief(got) == [(-99, "missing"), (-1, "changed")]


def test_audit_finds_all_damage_and_nothing_else(spark):
    rows = [(i, f"record {i} " + "é" * (i % 9)) for i in range(500)]
    bad = {3, 77, 78, 250, 499}
    other = [(i, r + "!" if i in bad else r) for i, r in rows]
    got = warc.audit(frame(spark, rows), frame(spark, other), 60).collect()
    assert {r.page_id for r in got} == bad and {r.status for r in got} == {"changed"}
    for r in got:
        mine = [x for x in rows if x[0] // 60 == r.page_id // 60 and x[0] < r.page_id]
        assert r.start_a == sum(len(x[1].encode()) for x in mine) and r.end_a - r.start_a == len(rows[r.page_id][1].encode())
        assert r.start_b == r.start_a + sum(x[0] in bad for x in mine) and r.end_b - r.start_b == r.end_a - r.start_a + 1
        assert r.digest_a == sha(rows[r.page_id][1]) and (r.file, r.idx) == (r.page_id // 60, r.page_id % 60)
    assert warc.audit(frame(spark, rows), frame(spark, rows), 60).count() == 0


def test_one_missing_record_is_one_row_and_few_branches_are_read(spark):
    rows = [(i, f"r{i}") for i in range(4096)]
    for other in (rows[:1234] + rows[1235:], [(i, r + "x" if i == 1234 else r) for i, r in rows]):
        leaf = [warc.leaves(warc.digests(frame(spark, x)), 256) for x in (rows, other)]
        top = warc.height(leaf, 256)
        differ, counts = warc.compare(*(warc.tree(x, top, 256) for x in leaf), 256)
        assert counts == [1] * (top + 1) and [(r.file, r.idx) for r in differ.collect()] == [(1234 // 256, 1234 % 256)]
    assert brief(warc.audit(frame(spark, rows), frame(spark, rows[:1234] + rows[1235:]))) == [(1234, "missing")]


def test_missing_extra_repeated_and_empty(spark):
    rows = [(i, f"r{i}") for i in range(100)]
    assert brief(warc.audit(frame(spark, rows), frame(spark, rows[:98]), 30)) == [(98, "missing"), (99, "missing")]
    assert brief(warc.audit(frame(spark, rows[:40]), frame(spark, rows), 30)) == [(i, "extra") for i in range(40, 100)]
    null = [(None, "a"), (None, "a"), (None, "b"), (5, "c"), (5, "c"), (5, "d")]
    assert warc.audit(frame(spark, null), frame(spark, null[::-1]), 10).count() == 0
    assert brief(warc.audit(frame(spark, null), frame(spark, null[1:]), 10)) == [(-99, "missing")]
    assert brief(warc.audit(frame(spark, null), frame(spark, null[:3] + [(5, "c"), (5, "e")]), 10)) == [(5, "extra"), (5, "missing"), (5, "missing")]
    assert warc.audit(frame(spark, []), frame(spark, [])).count() == 0
    assert brief(warc.audit(frame(spark, rows[:2]), frame(spark, []))) == [(0, "missing"), (1, "missing")]


def test_pages_and_files(spark, tmp_path):
    schema = "page_id long, url string, html string, record string, idx long, file long"
    rows = [(i, f"http://x/{i}", "<p>é\n" + "x" * i + "</p>", "no", 1, 2) for i in range(30)] + [(40, None, None, None, None, None), (None, "u", "lost", "", 0, 0), (-7, "v", "", "", 0, 0)]
    recs = warc.records(spark.createDataFrame(rows, schema))
    text = {r.page_id: r.record for r in recs.collect()}
    one = next(warc.parse(text[3].encode()))
    assert one["url"] == "http://x/3" and one["payload"].endswith("<p>é\nxxx</p>".encode()) and one["length"] == len(text[3].encode())
    assert len(list(warc.parse(gzip.compress("".join(text.values()).encode())))) == len(rows)
    warc.write_files(recs, str(tmp_path / "one"), 8)
    back = warc.read_files(spark, str(tmp_path / "one")).collect()
    assert sorted(r.digest for r in back) == sorted(map(sha, text.values())) and all(r.type == "response" for r in back)
    bad = warc.damaged(recs)
    assert brief(warc.audit(recs, bad)) == [(13, "changed"), (29, "missing")]
    warc.write_files(bad, str(tmp_path / "two"), 8)
    got = warc.audit_files(spark, str(tmp_path / "one"), str(tmp_path / "two"), 8)
    assert [r[:9] for r in sorted(got.collect())] == [r[:9] for r in sorted(warc.audit(recs, bad, 8).collect())]


def test_damaged_files_are_read_to_the_end(spark, tmp_path):
    recs = warc.records(spark.createDataFrame([(i, f"u{i}", f"html {i}") for i in range(6)], "page_id long, url string, html string"))
    parts = [r.record.encode() for r in sorted(recs.collect())]
    whole = b"".join(parts)
    cases = {
        "header": whole.replace(b"WARC/1.1", b"WARX/1.1", 3).replace(b"WARX/1.1", b"WARC/1.1", 2),
        "length": whole.replace(b"Content-Length: ", b"Content-Length: 9", 1),
        "junk": parts[0] + b"junk" + b"".join(parts[1:]),
        "short": whole[:-10],
        "noise": b"\x00\xff" * 9,
    }
    for name, data in cases.items():
        got = list(warc.parse(data))
        assert sum(r["length"] for r in got) == len(data) and [r["offset"] for r in got] == [sum(x["length"] for x in got[:i]) for i in range(len(got))], name
        assert any(r["type"] == "error" for r in got), name
        assert sum(r["type"] == "response" for r in got) >= (0 if name == "noise" else 5), name
    packed = b"".join(map(gzip.compress, parts))
    assert [r["type"] for r in warc.parse(packed)] == ["response"] * 6
    assert [r["type"] for r in warc.parse(packed[:-8])] and list(warc.parse(b"")) == []
    for side, data in (("one", whole), ("two", cases["junk"])):
        (tmp_path / side).mkdir()
        (tmp_path / side / "x.warc").write_bytes(data)
    got = warc.audit_files(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()
    assert [(r.page_id, r.status, r.digest_b) for r in got] == [(None, "extra", sha("junk"))]
