"""Functions on hand-written cases: one for each trap."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstack.functions import fields as fl
from quillstack.functions import keys as ky
from quillstack.functions import text as tx
from quillstack.functions import udfs
from quillstack.operators import changes, documents, keywords, pages, records, search
from quillstack.operators.graph import key_components
from quillstack.sources import bundles


def values(spark, make, *rows):
    """make's column over rows of one or more strings a, b, c."""
    wide = [r if isinstance(r, tuple) else (r,) for r in rows]
    names = "abc"[: len(wide[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(wide)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r["v"] for r in df.select("i", make(*(F.col(n) for n in names)).alias("v")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, tx.collapse_ws, " a  b\n\tc ", None) == ["a b c", ""]
    assert values(spark, tx.strip_markup, "a &amp;lt;b&amp;gt; <script>x</script><i>c</i>") == ["a c"]
    assert values(spark, tx.strip_tags, "a<br>b</p>c &lt;i&gt;") == ["a b c <i>"]
    assert values(spark, tx.strip_markdown, "# T\n- a *b* [c](d) `e` ```\nx\n```") == ["T a b c"]
    assert values(spark, lambda c: tx.truncate(c, 5), "abcdef", "abcde") == ["abcd…", "abcde"]
    df = spark.createDataFrame([({"the": [0, 2], "cat": [1]},)], "m map<string,array<int>>")
    assert df.select(tx.decode_inverted_index(F.col("m")).alias("v")).first()["v"] == "the cat the"
    assert tx.query_tokens('Foo "Bar Baz" x  y2') == ["foo", "bar baz", "y2"]
    assert values(spark, lambda c: tx.unique_tokens(c), "C++ a C++ node.js B2") == [["c++", "node.js", "b2"]]
    assert values(spark, tx.strip_title_annotation, "T [powered by X] 【翻訳】", "T [a]") == ["T", "T [a]"]
    assert values(spark, lambda c: tx.highlight(c, ["a<"]), "xA<b") == ["xA&lt;b"]
    assert values(spark, tx.clean_meta, "N/A", " x ") == ["", "x"]
    assert values(spark, tx.decode_json_literal, "a\\nb", "\\x") == ["a\nb", "\\x"]
    p = values(spark, tx.paragraphs, "One\n\n- a\n- b\n\n1. x\n2. y")[0]
    assert [(x.kind, x.lines) for x in p] == [("text", ["One"]), ("bullets", ["a", "b"]), ("numbers", ["x", "y"])]
    a = values(spark, tx.shortcode_args, 'src="a b" w=2 "pos one" two')[0]
    assert a.named == {"src": "a b", "w": "2"} and a.positional == ["pos one", "two"]
    assert values(spark, tx.sanitize_html, '<a href="javascript:x" onclick="y">z</a><script>q</script>') == ["<a>z</a>"]
    assert values(spark, tx.reference_definitions, "[A]: http://x\n```\n[b]: y\n```")[0][0].asDict() == {"label": "a", "url": "http://x"}
    assert values(spark, tx.rewrite_shortcodes, "{{< youtube abcdefghijk >}} {{< foo >}}x") == ["https://www.youtube.com/watch?v=abcdefghijk x"]
    assert values(spark, tx.english_ratio, "abé", "12") == [pytest.approx(2 / 3), 0.0]


def test_keys(spark):
    assert values(spark, ky.doi_key, "https://doi.org/10.1234/AbC.", "doi:10.12345/x)", "none") == ["10.1234/abc", "10.12345/x", ""]
    assert values(spark, ky.work_id, "https://x.org/w123", "W9", "x1") == ["W123", "W9", ""]
    s = values(spark, ky.person_signature, "Jane Q. Doe", "Doe")
    assert (s[0].base_key, s[0].initials, s[1].base_key) == ("jane|doe", "q", "doe|doe")
    assert values(spark, lambda a, b: ky.same_person(ky.person_signature(a), ky.person_signature(b)), ("Jane Q. Doe", "Jane Doe"), ("Jane Q. Doe", "Jane R. Doe"), ("José Doe", "Jose Doe")) == [True, False, True]
    assert values(spark, ky.split_speaker, "A B (MIT)", "A B - Foo", "A B, Foo University", "Doe, Jane")[0].asDict() == {"name": "A B", "affiliation": "MIT"}
    assert values(spark, ky.display_name, "Doe, Jane") == ["Jane Doe"]
    assert values(spark, ky.normalize_affiliation, "Univ. of X ,", "N/A") == ["University of X", ""]
    assert values(spark, ky.category, "Technical Session", "BoF", "odd") == ["technical-talk", "bof", "other"]
    assert values(spark, lambda c: ky.category_from_heading(c, [("talk", "t"), ("keynote talk", "k")]), "Keynote Talk", "a talk") == ["k", "t"]
    assert values(spark, lambda a, b, c: ky.identity_keys(a, b, c, F.lit("2020")), ("W1", "10.1234/x", "A b")) == [["oa:W1", "doi:10.1234/x", "title:2020:a b"]]
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a")], "n int, base string")
    assert sorted(r["id"] for r in ky.with_unique_ids(df, "base", "n").collect()) == ["a", "a-2", "a-3", "a-4"]
    assert values(spark, ky.compatible_last_names, ("doe", "van doe"), ("doe", "roe")) == [True, False]


def test_fields(spark):
    assert values(spark, fl.youtube_id, "https://youtu.be/abcdefghijk?t=1", "https://www.youtube.com/watch?v=abcdefghijk", "https://youtube.com/embed/abcdefghijk", "https://youtu.be/short") == ["abcdefghijk"] * 3 + [""]
    d = values(spark, fl.meeting_dates, "March 1-5, 2025", "November 17, 2014", "Oct 3rd, 2013", "March 30-April 2, 2025")
    assert [(x.start, x.end) if x else None for x in d] == [(dt.date(2025, 3, 1), dt.date(2025, 3, 5)), (dt.date(2014, 11, 17),) * 2, (dt.date(2013, 10, 3),) * 2, None]
    assert values(spark, fl.meeting_date_label, "March 1-5, 2025", " odd ") == ["March 1-5, 2025", "odd"]
    assert values(spark, fl.slug_sort_hint, "2025-03", "2014-11-17", "x") == ["2025-03-00", "2014-11-17", "0000-00-00"]
    assert values(spark, fl.absolute_url, ("https://x.org/a/", "b.pdf"), ("https://x.org/a/", "/c"), ("https://x.org/a", "http://y/")) == ["https://x.org/a/b.pdf", "https://x.org/c", "http://y/"]
    assert values(spark, fl.query_parameters, "?a=1&b=x+y&a=2") == [{"a": "2", "b": "x y"}]
    assert values(spark, fl.safe_url, "javascript:x", "https://x", "a/b") == ["", "https://x", "a/b"]
    assert values(spark, fl.author_list, "A B and C D; a b") == [["A B", "C D"]]
    assert values(spark, fl.csv_values, "a, ,b") == [["a", "b"]]
    assert values(spark, fl.parse_int, "3.0", " 7 ", "x") == [None, 7, None]
    assert values(spark, lambda c: fl.is_subsequence("wdg", c), "widget", "wid") == [True, False]
    assert values(spark, fl.rebuild_venue, ("P", "p | Vol. 1")) == ["P | Vol. 1"]
    assert values(spark, fl.derive_publication, ("", "J | Vol. 1"), ("", "Vol. 1")) == ["J", ""]
    assert values(spark, fl.classify_type, ("Dissertation", ""), ("article", "")) == ["thesis", "research-paper"]
    assert values(spark, fl.video_link_label, "https://x.org/a.mp4", "https://vimeo.com/1", "") == ["Download", "Watch on vimeo.com", ""]
    assert values(spark, lambda a, b: fl.pdf_score(a, b)["score"], ("http://x/foo.pdf", "foo"), ("http://x/foo-slides.pdf", "foo"), ("http://x/a.pdf", "")) == [200, 100, 0]


def test_udfs(spark):
    assert values(spark, udfs.html_unescape, "&amp;amp;eacute;") == ["é"]
    assert values(spark, udfs.fold_nfkd, "Ĳ Ångström") == ["ij angstrom"]
    assert values(spark, lambda a, b: udfs.strip_leading_title(a, b), ("My Title", "My Title"), ("My Title is good", "My Title")) == ["", "My Title is good"]
    assert values(spark, lambda a, b: udfs.clean_abstract(a, b, F.array(F.lit("Ann Lee"))), ("T [video] [slides] Speaker: Ann Lee - Hello", "T")) == ["Hello"]
    m = values(spark, udfs.front_matter, "---\ntitle: 'A b'\ntags: [x, \"y z\"]\nauthors:\n- q\n- r\n---\nbody")[0]
    assert m.meta == {"title": ["A b"], "tags": ["x", "y z"], "authors": ["q", "r"]} and m.body == "body"
    js = 'var X = [{title: "a" + " b", year: 2003, u: null}, // c\n {title: \'it\\\'s\', year: 4}];'
    assert udfs.parse_js_objects(js, "X") == [{"title": "a b", "year": "2003", "u": ""}, {"title": "it's", "year": "4"}]


def test_fuzzy_tiers(spark):
    words = ["token", "tokens", "atokenb", "t.o.k.e.n", "tokan", "zzz"]
    assert values(spark, lambda c: search.fuzzy_word_score("token", c), *words) == [20, 16, 14, 11, 10, 0]
    assert values(spark, lambda c: search.fuzzy_word_score("tokenize", c), "tokanise") == [8]


def test_components(spark):
    rows = [(1, ["doi:x"]), (2, ["doi:x", "title:y"]), (3, ["title:y"]), (4, ["z"]), (5, [])]
    got = {r["id"]: r["component"] for r in key_components(spark.createDataFrame(rows, "id int, keys array<string>"), "id", "keys").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_people_variants(spark):
    rows = [("janeqdoe", "Jane Q. Doe", {"X": 1}), ("janedoe", "Jane Doe", None), ("janerdoe", "Jane R. Doe", {"Y": 1})]
    df = spark.createDataFrame(rows, "key string, name string, affiliations map<string,bigint>")
    got = {r["key"]: r["merged_key"] for r in records.merge_name_variants(df).collect()}
    assert got == {"janedoe": "janedoe", "janeqdoe": "janedoe", "janerdoe": "janerdoe"}


def test_snapshots(spark):
    schema = "id string, slides string, video string"
    now = spark.createDataFrame([("new", "s", None), ("s", "x", None), ("sv", "x", "y"), ("same", "x", "y")], schema)
    old = spark.createDataFrame([("s", None, None), ("sv", " ", None), ("same", "x", "y"), ("gone", "", "")], schema)
    got = {r["id"]: r["fingerprint"] for r in changes.diff(now, old, "id", {"slides": "slides", "video": "video"}, "talk", "talk").collect()}
    assert got == {"new": "talk:new:talk+slides", "s": "talk:s:slides", "sv": "talk:sv:slides+video"}


def test_pages(spark):
    html = '<h1>M</h1><p><b>Hall A</b></p><div class="session-entry"><i>One</i> Speakers: A, B<br><p>short</p><p>much longer</p></div><p><b>Posters:</b></p><div class="session-entry"><i>Two</i></div>'
    got = pages.session_entries(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").orderBy("pos").collect()
    # a heading that names no category changes nothing
    assert [(r["category"], r["title"], r["speakers"], r["abstract"]) for r in got] == [("technical-talk", "One", "A, B", "much longer"), ("poster", "Two", "", "")]
    script = "<script>x = {headline: 'It\\'s A Fine Title', \"summary\": \"too short\"}; title: 'abc'</script>"
    assert [(r["kind"], r["label"], r["value"]) for r in values(spark, pages.script_candidates, script)[0]] == [("title", "script:headline", "It's A Fine Title")]
    long = "<script>description = \"" + "word " * 2300 + "\"</script>"
    assert [len(r["value"]) for r in values(spark, pages.script_candidates, long)[0]] == [11499]
    assert values(spark, lambda c: pages.first_link(c, "video"), '<a href="x">Slides</a><a href="y">The Video</a>') == ["y"]
    assert values(spark, lambda c: pages.labelled_value(c, ["Where", "Location"]), "<li><b>Location:</b> Here</li>") == ["Here"]


def plain_choice(ranked, lex, limit):
    """Phrases in order of rank; one within another is passed over, one that holds the last such takes its place."""
    out = []
    for phrase in ranked:
        shown = " ".join(lex.formats.get(w, w.capitalize()) for w in phrase.split())
        key = "".join(c for c in shown.lower() if c.isascii() and c.isalnum())
        if len(out) >= limit or not key or any(key in k for k, _ in out):
            continue
        held = [i for i, (k, _) in enumerate(out) if k in key]
        if held:
            out[held[-1]] = key, shown
        else:
            out.append((key, shown))
    return [p for _, p in out]


def test_keywords(spark):
    d = spark.createDataFrame([(1, "Loop vectorization", "We study loop vectorization and loop fusion. Loop fusion helps.")], "id int, title string, abstract string")
    k = keywords.mined_keywords(d, "id", "title", "abstract").first()["keywords"]
    assert "Loop Vectorization" in k and "Loop Fusion" in k
    assert values(spark, lambda c: F.array_join(keywords.rule_labels(c, [("X", "abc")]), ","), "éabc", "xabc") == ["X", ""]
    assert keywords.discovery_queries(["a"], ["b", "B"], "p") == ["a", "p b"]


@pytest.mark.parametrize("limit", [3, 14])
def test_mined_keywords_equal_a_plain_loop(spark, limit):
    import random

    r, words = random.Random(5), "loop loops fusion vectorization gpu-offload ir thing things parallel analysis x86 code".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(4)), ". ".join(" ".join(r.choice(words) for _ in range(6)) for _ in range(4))) for i in range(40)]
    d, lex = spark.createDataFrame(rows, "id int, title string, abstract string"), keywords.Lexicon()
    ranked = {}
    for x in keywords.mined_phrases(keywords.phrase_scores(d, "id", "title", "abstract", lex), lex).collect():
        ranked.setdefault(x["id"], []).append((-x["score"], x["phrase"]))
    got = {x["id"]: x["keywords"] for x in keywords.mined_keywords(d, "id", "title", "abstract", lex, limit).collect()}
    assert got == {i: plain_choice([p for _, p in sorted(ps)], lex, limit) for i, ps in ranked.items()}
    assert max(map(len, got.values())) <= limit and len(got) > 30


def test_phrases_of_rows_that_share_an_id_are_added_up(spark, monkeypatch):
    """Whatever is left out early: phrases of single rows are final, those of others are not."""
    import random
    from collections import Counter

    monkeypatch.setattr(keywords, "SLICE", 20)
    r, words = random.Random(6), "loop fusion vectorization gpu-offload ir the 2020 12+ x86 ab code".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i if i % 5 else None, text(r.randint(0, 5)), text(r.randint(0, 12))) for i in [*range(30), 3, 3, 4]] + [(90, None, None), (91, "", "fusion " * 60)]
    lex, want = keywords.Lexicon(), Counter()
    for i, *both in rows:
        for in_title, t in zip((1, 0), both, strict=True):
            t = (t or "").replace("gpu-offload", "gpu -offload").replace("12+", "12 +").split()
            t = [w for w in ([x.lstrip("-+") for x in t]) if w]
            for n in (1, 2, 3):
                for k in range(len(t) - n + 1):
                    if not {"the", "2020", "12", "ab"} & set(t[k : k + n]):
                        want[i, " ".join(t[k : k + n]), n, in_title] += 1
    d = spark.createDataFrame(rows, "id int, title string, abstract string").repartition(3)
    got = {(x["id"], x["phrase"], x["n"]): (x["title_hits"], x["abstract_hits"]) for x in keywords.phrase_scores(d, "id", "title", "abstract", lex).collect()}
    assert got == {k[:3]: (want[*k[:3], 1], want[*k[:3], 0]) for k in list(want)}
    every, early = (sorted(keywords.mined_phrases(keywords.phrase_scores(d, "id", "title", "abstract", lex, met_only=m), lex).collect(), key=str) for m in (False, True))
    assert early == every and {x["id"] for x in early} >= {3, None, 91}
    assert keywords.phrase_scores(d, "id", "title", "abstract", lex, met_only=True).count() < len(got)


def test_mining_predicates(spark):
    lex = keywords.Lexicon()
    assert values(spark, lambda c: keywords.is_candidate(c, lex), "the", "2020", "12+", "ir", "ab", "a-", "loop", "x86") == [False, False, False, True, False, False, True, True]
    assert values(spark, lambda c: keywords.is_technical(c, lex), "gpu", "x86", "gpu-offload", "a-b", "analysis", "loop") == [True, True, True, False, True, False]
    assert values(spark, lambda c: keywords.is_low_signal(F.split(c, " "), lex), "abc", "ir", "loop loop", "a loop a", "new loop", "loop fusion") == [True, False, True, True, True, False]


def test_options():
    documents.check_options(1, "a/b", 0)
    for bad in ({"batch_size": 0}, {"repository": "a"}, {"repository": "a/"}, {"max_posts": -1}):
        with pytest.raises(ValueError, match="must"):
            documents.check_options(**bad)


def test_documents(spark):
    j = values(spark, lambda a, b, c: documents.talk_json_ld(a, b, c, F.lit(None)), ("T", "", "v"))[0]
    assert json.loads(j) == {"@context": "https://schema.org", "@type": "VideoObject", "name": "T", "contentUrl": "v"}
    assert values(spark, lambda c: documents.action_label(c, F.lit(False)), "x.pdf?y", "x") == ["PDF", "Paper"]


def test_bundles(spark, tmp_path):
    good = {"meeting": {"slug": "2020-01", "name": "M"}, "talks": [{"id": "2020-01-001", "title": "A", "tags": ["x"]}]}
    (tmp_path / "index.json").write_text(json.dumps({"dataVersion": "1", "eventFiles": ["a.json", {"file": "gone.json"}.get("file"), "bad.json"]}))
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("{nope")
    version, files, _ = bundles.load_manifest(spark, [str(tmp_path / "none.json"), str(tmp_path / "index.json")], ("eventFiles", "events"))
    assert (version, files) == ("1", ["a.json", "gone.json", "bad.json"])
    b = bundles.read_bundles(spark, str(tmp_path), files, bundles.EVENT_BUNDLE, "talks", strict=False)
    assert b.count() == 2 and [r["title"] for r in bundles.talks(b.where("_corrupt_record is null")).collect()] == ["A"]
    with pytest.raises(Exception, match="malformed bundle|bad"):
        bundles.read_bundles(spark, str(tmp_path), ["a.json", "bad.json"], bundles.EVENT_BUNDLE, "talks").select("talks").collect()
    with pytest.raises(bundles.ManifestError):
        bundles.normalize_manifest({"dataVersion": "", "eventFiles": ["a.json"]}, ("eventFiles",))
    (tmp_path / "seeds.txt").write_text("# c\none\ntwo:b, c\n")
    assert sorted(tuple(r) for r in bundles.seeds(spark, str(tmp_path / "seeds.txt")).collect()) == [("one", "one"), ("two", "b"), ("two", "c"), ("two", "two")]
    out = str(tmp_path / "t")
    d = spark.range(5)
    assert bundles.save_if_changed(d, out) and not bundles.save_if_changed(d.orderBy(F.desc("id")), out) and bundles.save_if_changed(spark.range(6), out)


def test_stream(spark, tmp_path):
    from quillstack.streaming.updates import append_each_batch

    src, out = tmp_path / "in", str(tmp_path / "log")
    src.mkdir()
    (src / "1.json").write_text('{"fingerprint": "a"}\n{"fingerprint": "a"}\n{"fingerprint": "b"}\n')
    for turn in range(2):
        s = spark.readStream.schema("fingerprint string").json(str(src))
        append_each_batch(s, out, str(tmp_path / f"cp{turn}")).awaitTermination(60)
    assert sorted(r["fingerprint"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
