"""Element trees and inheritance against plain walks."""

import random
import re

from gneiss.operators import trees as T


def plain_tree(html):
    html, stack, out, last = re.sub(T.HIDDEN, "", html or ""), [], [], {}
    heads = {None: None}
    k = -1
    for m in re.finditer(r"(</?)([A-Za-z][A-Za-z0-9]*)", html):
        k += 1
        tag = m[2].lower()
        if m[1] == "</":
            if tag in T.HOLDERS and stack:
                stack.pop()
            continue
        parent = stack[-1] if stack else None
        own = last.get(parent, heads[parent])
        out.append((k, tag, len(stack) + 1, parent, own))
        heads[k] = own
        if re.fullmatch("h[1-6]", tag):
            last[parent] = k
        if tag in T.HOLDERS:
            stack.append(k)
    return out


def test_element_trees_equal_a_walk(spark):
    r = random.Random(3)
    bits = ["<div>", "<div class='x'>", "</div>", "<p>", "</p>", "<h1>", "</h1>", "<H2>", "</h2>", "text", "<br>", "<!-- <div> -->", "<script>'<ul>'</script>", "<ul>", "</ul>", "<li>", "</li>"]
    pages = [(i, "".join(r.choice(bits) for _ in range(r.choice([0, 5, 40])))) for i in range(60)] + [(90, None), (91, ""), (92, "</div></div><div><p></div></div></div><h1></h1><div><div><p>"), (93, "<div>" * 40 + "<p>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = sorted(((x.page_id, x.k, x.tag, x.depth, x.parent, x.heading) for x in T.element_trees(df).collect()), key=str)
    assert got == sorted(((i, *row) for i, html in pages for row in plain_tree(html)), key=str)
    assert T.element_trees(df.limit(0)).count() == 0


def test_inheritance_follows_long_chains(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, "top" if i == 3 else None) for i in range(50)] + [(2, 5, 4, None)], "g int, n int, up int, v string")
    got = {(r.g, r.n): r.v for r in T.inherited(chain, "g", "n", "up", "v").collect()}
    assert got == {(1, i): "top" if i >= 3 else None for i in range(50)} | {(2, 5): None}
