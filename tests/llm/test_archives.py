"""Archives as they are met: gzipped by record, broken lines, records without keys."""

import gzip

import pytest

from spanmill.llm import warc

PAGES = [("1", "http://a/", b"first page"), ("2", "http://b/", b"second\n\nhttp://x/ 0.0.0.0 20010203040506 text/html 5\nabcde"), (None, "http://c/", b"third")]


def records(data):
    """The parts of an ARC file, each with its header, as they are cut by their lengths."""
    bounds = [at for _, _, at in warc.read_arc(data)] + [len(data)]
    return [data[: bounds[0]], *[data[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]]


@pytest.mark.parametrize("version", [1, 2])
def test_gzip_members(version):
    data = warc.write_arc(PAGES, version)
    for packed in (gzip.compress(data), b"".join(gzip.compress(r) for r in records(data))):
        assert [(r["key"], r["payload"]) for r in warc.arc_to_warc(packed)] == [(k, p) for k, _, p in PAGES]
    short = b"".join(gzip.compress(r) for r in records(data))[:-9]
    seen = []
    assert len(list(warc.arc_to_warc(short, lambda at, what: seen.append(what)))) >= 2


@pytest.mark.parametrize("version", [1, 2])
def test_bad_records_are_told_and_passed_over(version):
    parts = records(warc.write_arc(PAGES, version))
    broken = [parts[1].replace(b"http://a/", b"http://a/ http://a/", 1), b"no header at all\n", b"http://a/ 1.1.1.1 x y -5\n", parts[1].replace(b"\n", b"x\n", 1)]
    for bad in broken:
        data, seen = parts[0] + bad + parts[2] + parts[3], []
        got = [(r["key"], r["payload"]) for r in warc.arc_to_warc(data, lambda at, what: seen.append((at, what)))]  # noqa: B023
        assert got[-2:] == [(k, p) for k, _, p in PAGES[1:]] and len(seen) == 1 and seen[0][0] == len(parts[0])
        with pytest.raises(ValueError):
            list(warc.read_arc(data))
    seen = []
    assert list(warc.arc_to_warc(b"filedesc://x 0 0 0 5\n9 zzz\n" + parts[1], lambda at, what: seen.append(what))) == [] and "version" in seen[0]
    assert list(warc.arc_to_warc(b"", seen.append)) == []


def test_errors_are_rows_and_null_keys_are_revisited(spark, tmp_path):
    same = [(None, "http://a/", b"same"), (None, "http://a/", b"same"), (None, "http://b/", b"same"), ("7", "http://c/", b"other")]
    good = warc.write_arc(same, 1)
    parts = records(good)
    rows = [(good,), (parts[0] + b"junk\n" + parts[4],), (None,), (b"",)]
    found = warc.convert(spark.createDataFrame(rows, "arc binary").coalesce(1))
    assert [r["error"] for r in found.filter("error is not null").collect()] == [f"header at {len(parts[0])} declares no length"]
    ready = warc.with_revisits(found)
    warc.write(ready, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    none = [r for r in got if r["page_id"] is None]
    assert sorted(r["record_type"] for r in none) == ["response", "revisit", "revisit"] and {r["record_type"] for r in got if r["page_id"] == "7"} == {"response"}
    assert len(got) == 5
