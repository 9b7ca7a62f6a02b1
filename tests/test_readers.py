import io
import json
import os
import resource
import tarfile

import pytest

from quillstack.sources import readers


def add(tar, name, text):
    info = tarfile.TarInfo(name)
    info.size = len(text)
    tar.addfile(info, io.BytesIO(text))


POSTS = {"r/content/posts/b.md": b"two", "r/content/posts/A.HTML": b"one", "r/content/posts/sub/c.markdown": "drei é".encode(), "r/content/posts/bad.md": b"\xff\xfe", "r/README.md": b"no", "r/content/posts/x.png": b"no"}


@pytest.mark.parametrize("mode", ["", "gz"])
def test_posts_in_order(spark, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(readers, "PART", 600)
    for n in range(2):
        with tarfile.open(tmp_path / f"a{n}.tar{'.' + mode if mode else ''}", f"w:{mode}") as tar:
            for name, text in POSTS.items():
                add(tar, name, text)
    (tmp_path / "other.txt").write_text("no archive")
    got = sorted((r.archive[-8:], r._seq, r.path, r.text) for r in readers.posts_of(spark, str(tmp_path)).collect())
    want = sorted((p for p in POSTS if p.startswith("r/content/posts/") and not p.endswith("png")), key=str.lower)
    assert [(s, p) for _, s, p, _ in got] == 2 * list(enumerate(want)) and got[0][3] == "one" and got[1][3] == "two" or got[2][3] == "two"
    assert readers.posts_of(spark, str(tmp_path), longest=1).count() == 2


@pytest.mark.parametrize("packed", [False, True])
def test_an_archive_of_more_than_two_gigabytes(tmp_path, packed):
    large = 2_200_000_000
    plain = tmp_path / "large.tar"
    with plain.open("wb") as f:  # a member of zeros, as a hole in the file, then a post
        info = tarfile.TarInfo("r/junk.bin")
        info.size = large
        f.write(info.tobuf())
        f.seek(f.tell() + (large + 511) // 512 * 512)
        rest = io.BytesIO()
        with tarfile.open(fileobj=rest, mode="w:") as tar:
            add(tar, "r/content/posts/late.md", b"found")
        f.write(rest.getvalue())
    path = plain
    if packed:
        import gzip
        import shutil

        path = tmp_path / "packed" / "large.tar.gz"
        path.parent.mkdir()
        with plain.open("rb") as src, gzip.open(path, "wb", compresslevel=1) as out:
            shutil.copyfileobj(src, out, 1 << 22)
        plain.unlink()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    reader = readers.ArchiveReader({"path": str(path), "pattern": readers.POSTS})
    rows = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert [(r["path"], r["text"]) for b in rows for r in b] == [("r/content/posts/late.md", "found")]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
    os.remove(path)


def test_pages_up_to_the_last(spark, tmp_path):
    def page(slug, n, works, count):
        (tmp_path / f"{slug}-y2000-n2-p{n}.json").write_text(json.dumps({"results": [{"id": i, "title": t} for i, t in works], "meta": {"count": count}}))

    page("deep-learning", 1, [("W1", "a"), ("W2", "b")], 5)
    page("deep-learning", 2, [("W3", "c"), ("", "no id")], 5)
    page("deep-learning", 3, [("W1", "later")], 5)
    page("deep-learning", 4, [("W9", "beyond the last")], 5)
    page("gap", 2, [("W8", "behind a page that is missing")], 9)
    page("none", 1, [], 9)
    page("none", 2, [("W7", "behind an empty page")], 9)
    page("keyword", 1, [("W4", "é")], 1)
    got = readers.discovered_works(spark, f"file://{tmp_path}", ["Deep  Learning!", "gap", "none", "!?"], "id string, title string", 2000, 2)
    assert sorted(tuple(r) for r in got.collect()) == [("W1", "later"), ("W2", "b"), ("W3", "c"), ("W4", "é")]
    assert readers.discovered_works(spark, str(tmp_path), ["deep learning"], "id string, title string", 2000, 2, max_pages=1).count() == 2
