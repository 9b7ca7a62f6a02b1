from quillstack.plans.spec import SearchSpec, apply, exact_entry, initial_query, routes_to_all


def test_address_round_trip():
    s = SearchSpec.parse("?q=a+b&topic=X,Y,X&year=2020&video=1&q=c")
    assert s == SearchSpec(query="c", topics=("X", "Y"), years=("2020",), has_video=True)
    assert SearchSpec.parse(s.to_query_string()) == s


def test_changes():
    s = SearchSpec(query="loops").add_topic("Loops").add_topic("LOOPS!")
    assert s.topics == ("Loops",) and s.cross_selection() == ("topic", "Loops")
    assert s.active_filters() == 2 and s.active_filters(papers=True) == 1
    assert s.remove_topic("loops") == SearchSpec() == s.toggle_topic("loops")
    m = SearchSpec(years=("2019", "2020")).with_meeting("2020-01")
    assert m.years == () and m.with_years(("2019",)).meeting == "" and m.with_years(("2020",)).meeting == "2020-01"
    assert SearchSpec().with_years(("2020",)).with_meeting("2020-01").years == ("2020",)
    assert SearchSpec().selected("person", "A").person == "A"


def test_initial_query():
    assert initial_query("mode=search&q=x") == ("search", "x") and initial_query("speaker=A") == ("entity", "A")
    assert initial_query("tags=a,b") == ("entity", "a") and initial_query("") == ("browse", "")


def test_frames(spark):
    e = spark.createDataFrame([("talks", " Ann "), ("papers", "Bo")], "corpus string, label string")
    assert exact_entry(e, "ann").count() == 1
    assert not routes_to_all(e, "Ann", "talks", 3, 0) and routes_to_all(e, "bo", "talks", 3, 0) and routes_to_all(e, "zz", "talks", 0, 2)
    rows = [(1, ["Jane Doe"], ["C++"], "2020", "bof", "m", "v", ""), (2, ["Bo"], ["C"], "2021", "bof", "m", None, "s")]
    d = spark.createDataFrame(rows, "id int, people array<string>, topics array<string>, year string, category string, meeting string, video string, slides string")
    ask = lambda **k: [r["id"] for r in apply(d, SearchSpec(**k), "people", "topics", "year", "category", "meeting", "video", "slides").collect()]
    assert ask(person="Jane Q. Doe") == [1] and ask(topics=("c++",)) == [1] and ask(years=("2021",), has_slides=True) == [2] and ask(has_video=True) == [1]
