from __future__ import annotations

from pyspark.sql import functions as F

from affinis.llm import chat, url_filter

PAGES = "page_id bigint, url string, rule string, short string"


def test_url_precedence_and_odd_rows(spark):
    rules = spark.createDataFrame(
        [("example.com/", "block"), ("a.example.com/", "allow"), ("a.example.com/bad/", "block"), ("a.example.com/bad/ok.html", "allow"), ("tie.org/", "block"), ("tie.org/", "allow"), ("q.org/x?y=1", "block"), (None, "block"), ("n.org/", None)],
        "expression string, action string",
    )
    urls = [
        ("http://example.com", "block"), ("https://b.EXAMPLE.com./x/y?z#f", "block"), ("http://a.example.com/", "allow"), ("http://a.example.com/bad/x", "block"),
        ("http://u:p@a.example.com:80/bad/ok.html", "allow"), ("http://tie.org/p", "allow"), ("http://q.org/x?y=1", "block"), ("http://q.org/x?y=2", "allow"),
        ("http://notexample.com/", "allow"), (None, "invalid"), ("", "invalid"), ("mailto:x", "invalid"), ("http://n.org/", "allow"), ("http://example.com", "block"),
        ("http://x.example.com/" + "d/" * 3000, "block"),
    ]
    pages = spark.createDataFrame([(i if i else None, u, "clash", "clash") for i, (u, _) in enumerate(urls)], PAGES)
    got = sorted((r.page_id or 0, r.url, r.action, r.kept) for r in url_filter.filter_urls(pages, rules).collect())
    assert [(u, a, a == "allow") for u, a in urls] == [x[1:] for x in got]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.action for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow", "invalid"}


def test_bounded_expansion_loses_no_match(spark):
    urls = ["http://a.b.c.d.example.com/x/y/z/w.html?q=1", "http://1.2.3.4/x/", "http://example.com", "http://a.example.com/x/y", "http://a.b.example.com/x?y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for labels, depth in ((2, 1), (3, 2), (9, 9)):
        rows = df.select("url", url_filter.url_expressions(F.col("url")).alias("all"), url_filter.url_expressions(F.col("url"), labels, depth).alias("some")).collect()
        for r in rows:
            can = {e for e in r["all"] if len(e.split("/")[0].split(".")) <= labels and e.count("/") <= depth}
            assert can <= set(r["some"]) <= set(r["all"])


def reference(rows, template):
    out = {}
    chats = {}
    for c, t, r, x in rows:
        if c is not None:
            chats.setdefault(c, set()).add((t, r, x))
    for c, turns in chats.items():
        numbers = [t for t, _, _ in turns]
        state, status = template.start, None
        if None in numbers:
            status = "null turn"
        elif len(set(numbers)) < len(numbers):
            status = "repeated turn"
        elif any(r not in template.segments for _, r, _ in turns):
            status = "unknown role"
        elif any(x is None for _, _, x in turns):
            status = "null text"
        else:
            for _, r, _ in sorted(turns):
                state = template.moves.get((state, r), "dead")
            status = "ok" if state in template.accept else "bad order"
        out[c] = [(-1, None, False, status)] if status != "ok" else [(i, *s, "ok") for i, s in enumerate((x if f is None else f, loss) for _, r, x in sorted(turns) for f, loss in template.segments[r])]
    return out


def test_chats_against_a_plain_machine(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 5, "assistant", ""), (2, 0, "user", "u"), (2, 0, "assistant", "a"), (3, 0, "user", None), (3, 1, "assistant", "a"),
        (4, 0, "robot", "x"), (5, None, "user", "x"), (6, 0, "assistant", "a"), (7, 0, "user", "u"), (7, 0, "user", "u"), (7, 1, "assistant", "a"), (None, 0, "user", "u"),
        (8, 0, "user", "x" * 100000), (8, 1, "assistant", "y"), (8, 2, "tool", "t"), (8, 3, "assistant", "z"), (9, 0, None, "x"), (10, 0, "user", "u"), (11, 1, "system", "s"), (11, 2, "system", "s"),
    ]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, seg int, status string")
    for most_rows, part_turns in ((4096, 4096), (0, 1), (0, 2), (2, 3), (0, 4096)):
        got = {}
        for r in chat.format_chats(df, most_rows=most_rows, part_turns=part_turns).collect():
            got.setdefault(r.conv_id, []).append((r.seg, r.text, r.loss, r.status))
        assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == reference(rows, chat.CHAT)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_conversation_with_most_of_the_rows(spark):
    """The long way gives the columns and the rows of the short one, turns, roles and copies of rows included."""
    long = [("a", 3 * i - 40, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(200)]
    rows = [*long, *long[:30], ("b", 1, "user", "u"), ("b", 2, "assistant", "x"), *(("c", 5, "user", f"u{i}") for i in range(90)), *(("d", i, "user", "u") for i in range(60))]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    short, cut = chat.format_chats(df), chat.format_chats(df, most_rows=50, part_turns=16)
    assert short.dtypes == cut.dtypes
    assert sorted(short.collect(), key=str) == sorted(cut.collect(), key=str)
    assert {r.status for r in cut.collect()} == {"ok", "repeated turn", "bad order"}
