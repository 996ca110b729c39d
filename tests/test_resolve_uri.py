"""The registered resolve-uri over pages, against RFC 3986 by hand."""

import __spark_entry__

HANDMADE = {
    "http://h/a": "http://h/x", "http://h/": "http://h/x", "http://h/a/b": "http://h/x", "http://h/a/b/c": "http://h/a/x", "http://h/a/b/": "http://h/a/x",
    "https://h:8080/a/b/c/d?q=../z/y": "https://h:8080/a/b/x", "http://h/a/b/c#top/../x": "http://h/a/x", "http://h/a/./b/../c/d": "http://h/a/x",
}


def brute(base):
    """'../x' against a base with an authority: merge, then remove the dot segments."""
    head, _, rest = base.partition("://")
    host, _, path = rest.split("#")[0].split("?")[0].partition("/")
    out = []
    for part in [*path.split("/")[:-1], "..", "x"]:
        if part == "..":
            out = out[:-1]
        elif part != ".":
            out.append(part)
    return f"{head}://{host}/{'/'.join(out)}"


def test_resolve_uri(spark, tmp_path):
    urls = [*HANDMADE, *(f"http://h/{'d/' * i}p.html?i={i}#f" for i in range(40))]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.k: r.v for r in __spark_entry__.queries()["fn_resolve_uri"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert [got[i] for i in range(len(HANDMADE))] == list(HANDMADE.values())
