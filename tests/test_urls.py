from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators import extraction


def test_strategies(spark):
    rows = [("plain", True, False, "n", "p", "positioned-filtered", "p"), ("table", False, False, "n", "p", "positioned", "p"), ("plain", False, True, "n", "p", "positioned-aligned", "p"), ("plain", False, False, " n ", "p", "native", "n"), ("plain", False, False, " ", "p", "positioned-fallback", "p")]
    df = spark.createDataFrame(rows, "layout string, m boolean, o boolean, n string, p string, want string, text string")
    name, text = extraction.strategy(*map(F.col, ("layout", "m", "o", "n", "p")))
    for r in df.select("want", "text", name.alias("got"), text.alias("taken")).collect():
        assert (r["got"], r["taken"]) == (r["want"], r["text"])


def test_urls(spark):
    assert urls.with_parameters("https://a.b/c?x=1&y=#f", {"x": "2 3", "z": "4"}) == "https://a.b/c?x=2%203&y=&z=4#f"
    run = lambda h: spark.createDataFrame([(h,)], "h string").select(urls.add_to_first_href(F.col("h"), "q=a&s=1")).first()[0]
    assert run('<p><a class="x" href="/p?a=1#f">1</a><a href="/z">2</a>') == '<p><a class="x" href="/p?a=1&amp;q=a&amp;s=1#f">1</a><a href="/z">2</a>'
    assert run("<a href='/p'>1</a>") == "<a href='/p?q=a&amp;s=1'>1</a>" and run("no link") == "no link" and run("") == ""


def test_nested_parameters():
    tree = {"a": {"b": {"c": 1}}, "d": 2}
    assert urls.get_in(tree, ["a", "b", "c"]) == 1 and urls.get_in(tree, ["d", "x"]) is None
    assert urls.set_in(tree, ["a", "x"], 3) == {"a": {"b": {"c": 1}, "x": 3}, "d": 2}
    assert urls.remove_in(tree, ["a", "b", "c"]) == {"d": 2} and tree["a"] == {"b": {"c": 1}}
    assert urls.remove_in(tree, ["d", "x"]) == tree
