"""run() as a whole on the smallest tables: every stage against a plain version over what the stage before it kept."""

import re
from itertools import combinations

import pytest

import corpus_pipeline as P
from gneiss.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage by name, the documents first."""
    docs = table(spark, SF_DIR, "documents")
    out = {"documents": docs.collect()}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF_DIR))
        out[name] = docs.collect()
    return out


def texts(rows):
    return {r.doc_id: r.text or "" for r in rows}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def item_words(text):
    return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)) if x]


def test_columns_stay_until_packing(spark, kept):
    names = table(spark, SF_DIR, "documents").columns
    for name in [n for n, _ in P.STAGES[:-1]]:
        assert list(kept[name][0].asDict()) == names


def test_good_documents_stay(spark, kept):
    quality = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
    before, after = texts(kept["documents"]), texts(kept["quality"])
    assert after.items() <= before.items()
    good, bad = ([d for d, q in quality.items() if q == want and d in before] for want in (1, 0))
    assert sum(d in after for d in good) >= 0.9 * len(good)
    assert sum(d in after for d in bad) <= 0.3 * len(bad)


def test_lines_are_only_removed(kept):
    before, after = texts(kept["quality"]), texts(kept["line_dedup"])
    for r in kept["line_dedup"]:
        left = iter(before[r.doc_id].split("\n"))
        assert all(line in left for line in after[r.doc_id].split("\n"))
        assert r.text is None or r.n_chars == len(r.text)
    assert not any(before[d].strip() == "" for d in before.keys() - after.keys())


def test_first_of_each_group_stays(kept):
    sets = {d: shingles(t) for d, t in texts(kept["line_dedup"]).items()}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    assert texts(kept["similar"]).keys() == {d for d in sets if root(d) == d}


def test_documents_with_benchmark_windows_go(spark, kept):
    windows = set()
    for r in table(spark, SF_DIR, "benchmark").collect():
        w = item_words(r.text or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = item_words(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert texts(kept["decontaminate"]).keys() == {d for d, t in texts(kept["similar"]).items() if clean(t)}


def test_run_packs_what_is_left(spark, kept):
    packed = [(r.doc_id, r.n_tokens) for r in kept["pack"]]
    assert sorted(packed) == sorted((r.doc_id, r.n_tokens) for r in P.run(spark, SF_DIR).collect())
    assert sorted(d for d, _ in packed) == sorted(texts(kept["decontaminate"]))


def test_stages_decide_by_row(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    same, other = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    leak = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [(None, same), (None, same), (None, None), (1, same), (1, other), (1, other), (2, ""), (3, leak), (3, same), (None, leak), (4, "\n".join([other] * 2))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], names).repartition(3)
    stages = dict(P.STAGES)
    left = sorted(((r.doc_id, r.text) for r in stages["decontaminate"](spark, docs, SF_DIR).collect()), key=str)
    assert left == sorted((x for x in rows if x[1] != leak), key=str)
    left = [(r.doc_id, r.text) for r in stages["similar"](spark, docs, SF_DIR).collect()]
    texts = [t for _, t in left]
    assert texts.count(same) == 1 and texts.count(leak) == 1 and texts.count("") == 1 and texts.count(None) == 1 and (1, same) in left and (3, leak) in left
    assert stages["pack"](spark, docs, SF_DIR).count() == len(rows)
    assert stages["line_dedup"](spark, docs, SF_DIR).where("text IS NULL").count() == 1
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0
    assert P.STAGES[0][1](spark, docs, SF_DIR).columns == docs.columns
