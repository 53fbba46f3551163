"""Text files in all encodings, listings and their changes, rename plans that never overwrite."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import catalog as cat
from pixelquarry.sources import listing, text_lines

LINES = ["C:\\photos\\a.jpg", "", "Übermut größer", "x" * 300, "中文 é", "[Section]", "last"]
FORMS = {
    "plain": lambda t: t.encode(), "marked": lambda t: b"\xef\xbb\xbf" + t.encode(), "wide": lambda t: b"\xff\xfe" + t.encode("utf-16-le"),
    "big": lambda t: b"\xfe\xff" + t.encode("utf-16-be"), "unmarked": lambda t: t.encode("utf-16-le"),
}


@pytest.mark.parametrize("range_bytes", [2, 7, 64, 1 << 20])
def test_lines_of_all_encodings(spark, tmp_path, range_bytes):
    for name, form in FORMS.items():
        for end, tail in (("\n", "\n"), ("\n", "")):
            (tmp_path / f"{name}{len(tail)}.txt").write_bytes(form(end.join(LINES) + tail))
    (tmp_path / "ansi.txt").write_bytes("groß\nutf\n".encode("cp1252") + "é".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "mark.txt").write_bytes(b"\xff\xfe")
    got = {}
    for r in text_lines.read_text(spark, str(tmp_path), range_bytes=range_bytes).collect():
        got.setdefault(r.list_id.rsplit("/", 1)[1], {})[r.line_no] = r.line
    got = {f: [lines[n] for n in range(1, len(lines) + 1)] for f, lines in got.items()}
    assert got == {f"{name}{k}.txt": LINES for name in FORMS for k in (0, 1)} | {"ansi.txt": ["groß", "utf", "é"]}


def test_section_of_a_file(spark, tmp_path):
    (tmp_path / "a.ini").write_bytes(b"\xff\xfe" + "x=0\r\n[One]\r\na=1\r\n[ two ]\r\nb=2\r\n;c\r\n[ONE]\r\na=3\r\n".encode("utf-16-le"))
    (tmp_path / "b.ini").write_text("[two]\n")
    lines = text_lines.read_text(spark, str(tmp_path)).withColumn("line", F.regexp_replace("line", "\r$", ""))
    rows = lambda name: sorted((r.list_id[-5:], r.line_no, r.line) for r in text_lines.section(lines, name).collect())
    assert rows("one") == [("a.ini", 3, "a=1"), ("a.ini", 8, "a=3")] and rows("Two") == [("a.ini", 5, "b=2"), ("a.ini", 6, ";c")] and rows("none") == []


def test_three_listings(spark, tmp_path):
    def put(name, body, mtime):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        os.utime(path, (mtime, mtime))

    def listed(levels=None):
        return listing.list_tree(spark, tmp_path.as_uri(), ["jpg", "png"], levels)

    def went(before, now, at):
        found = listing.changes(before, now, F.timestamp_seconds(F.lit(at)), 1000)
        return sorted((r.path.rsplit("/", 1)[1], r.kind) for r in found.collect())

    put("a.jpg", b"1", 100)
    put("sub/b.PNG", b"22", 100)
    put("sub/deep/c.jpg", b"333", 199.5)
    put("sub/notes.txt", b"x", 100)
    first = listed()
    assert sorted((r.title, r.ext, r.size, r.depth) for r in first.collect()) == [("a.jpg", "jpg", 1, 0), ("b.PNG", "PNG", 2, 1), ("c.jpg", "jpg", 3, 2)]
    assert [r.title for r in listed(1).collect()] == ["a.jpg"]
    none = first.limit(0)
    assert went(none, first, 200) == [("a.jpg", "created"), ("b.PNG", "created")]  # c.jpg was written only just now
    known = listing.settled(none, first, F.timestamp_seconds(F.lit(200)), 1000)
    put("a.jpg", b"44", 250)
    os.rename(tmp_path / "sub/b.PNG", tmp_path / "sub/deep/b2.png")
    put("fresh.jpg", b"5", 299.9)
    second = listed()
    assert went(known, second, 300) == [("a.jpg", "written"), ("b.PNG", "deleted"), ("b2.png", "created"), ("c.jpg", "created")]
    known = listing.settled(known, second, F.timestamp_seconds(F.lit(300)), 1000)
    put("a.jpg", b"6", 399.9)  # written again while it is looked at
    os.rename(tmp_path / "fresh.jpg", tmp_path / "gone.txt")
    third = listed()
    assert went(known, third, 400) == []
    known = listing.settled(known, third, F.timestamp_seconds(F.lit(400)), 1000)
    assert went(known, third, 500) == [("a.jpg", "written")]
    assert listing.list_tree(spark, (tmp_path / "nowhere").as_uri()).count() == 0


def apply(files, steps):
    """Carries a plan out; fails where a file would be overwritten."""
    def move(source, target, keep=False):
        assert target.lower() not in {f.lower() for f in files} - ({source.lower()} if not keep else set()), f"{target} is in the way"
        files[target] = files[source]
        if not keep and target != source:
            del files[source]

    done = [s for s in steps if s.state == "done"]
    for s in done:
        if s.copy:
            move(s.path, s.target, keep=True)
    for s in done:
        if s.via:
            move(s.path, s.via)
    for s in sorted((s for s in done if not s.copy), key=lambda s: (s.step, s.path)):
        move(s.via or s.path, s.target)
    return files


@pytest.mark.parametrize("seed", range(4))
def test_plans_never_overwrite(spark, seed):
    rng = np.random.default_rng(seed)
    paths = [f"/d/f{i}" for i in range(120)]
    names = [*paths, *(f"/d/new{i}" for i in range(40)), *(p.upper() for p in paths[:20])]
    plan = [(p, names[int(rng.integers(0, len(names)))], bool(rng.random() < 0.1)) for p in paths if rng.random() < 0.8]
    plan += [(f"/c/{i}", f"/c/{(i + 1) % 50}", False) for i in range(50)] + [(f"/l/{i}", f"/l/{i + 1}", False) for i in range(70)]
    there = paths + [f"/c/{i}" for i in range(50)] + [f"/l/{i}" for i in range(70)]
    steps = cat.rename_steps(spark.createDataFrame(plan, "path string, target string, copy boolean").repartition(3), spark.createDataFrame([(p,) for p in there], "path string")).collect()
    assert len(steps) == len(plan)
    left = apply({p: p for p in there}, steps)
    by = {s.path: s for s in steps}
    for p, t, copy in plan:
        assert (by[p].state == "done") == (left.get(t) == p and p != t) or by[p].state == "same"
    # nothing is refused without a file that stays in the way or a smaller path that goes there
    sources = {s.path.lower() for s in steps if s.state == "done" and not s.copy}
    for s in steps:
        if s.state == "collision":
            assert any(o.path < s.path and o.target.lower() == s.target.lower() for o in steps)
        if s.state == "exists":
            assert s.target.lower() in {p.lower() for p in there} and (s.copy or s.target.lower() not in sources)
    assert all(by[f"/c/{i}"].state == "done" for i in range(50)) and sum(by[f"/c/{i}"].via is not None for i in range(50)) == 1
    assert [by[f"/l/{i}"].step for i in range(70)] == list(range(70, 0, -1))


def test_an_empty_plan(spark):
    none = spark.createDataFrame([], "path string, target string, copy boolean")
    assert cat.rename_steps(none, none.select("path")).count() == 0
