import pytest

from tarnwise.functions import markdown


@pytest.fixture(scope="module")
def files(spark):
    a = "# Top\n\n## A & B\n## A & B\n### `code` **bold** ★\n[x](#top) [y](#a--b-1) [z](#a--b-2) [w](sub/b.md#über-uns) [e](https://x.y) [n](#code-bold-)"
    b = "## Über uns ##\n[up](../a.md#top) [gone](../c.md) [pic](p.png) [no](../a.md#nope)"
    return spark.createDataFrame([("a.md", a), ("sub/b.md", b), ("empty.md", None)], "path string, body string")


def test_anchors(files):
    bodies = {r.path: markdown.anchors(r.body) for r in files.collect()}
    assert bodies == {"a.md": ["top", "a--b", "a--b-1", "code-bold-"], "sub/b.md": ["über-uns"], "empty.md": []}


def test_broken_links(spark, files):
    got = {tuple(r) for r in markdown.broken_links(files, spark.createDataFrame([("sub/p.png",)], "path string")).collect()}
    assert got == {("a.md", "#a--b-2", "anchor"), ("sub/b.md", "../c.md", "file"), ("sub/b.md", "../a.md#nope", "anchor")}


@pytest.mark.parametrize(
    "line, found",
    [
        ("[a](b.md)", ["b.md"]), ("[a](b(1).md)", ["b(1).md"]), ("[a](<b c.md>)", ["b c.md"]), ('[a](b.md "t (x)")', ["b.md"]), ("![p](x.png)[a]( b.md )", ["x.png", "b.md"]),
        ("`[a](b.md)`", []), ("[a](", []), ("[a]()", []), (r"[a](b\).md)", [r"b\).md"]), ("[[in](one.md)](two.md)", ["one.md", "two.md"]),
    ],
)
def test_targets_of_a_line(line, found):
    assert [t for _, t in markdown.targets(line)] == found


def test_fenced_lines_are_no_text():
    body = "~~~ x\n[a](b.md)\n```\n# no\n~~~~\n# yes\n[c](d.md)"
    assert markdown.targets(body) == [(7, "d.md")] and markdown.anchors(body) == ["yes"]


def test_claims_and_structure(spark):
    df = markdown.sample(spark)
    assert [tuple(r) for r in markdown.count_claims(df, "list.md", r"(?m)^- ", ["entries", "cases"]).collect()] == [("b.md", 2, 7, 3)]
    assert {tuple(r) for r in markdown.structure(df, ["## Use"]).collect()} == {("b.md", "no front matter"), ("list.md", "no name"), ("list.md", "no section ## Use")}
