import random
import re
from difflib import SequenceMatcher

from valograph.operators import filematch
from valograph.operators.filematch import contained_pairs, fuzzy_file_matches


def plain(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip()


def brute(files, papers):
    out = {}
    for paper_id, title in papers:
        if f"Source_{paper_id}.pdf" in files:
            out[paper_id] = (f"Source_{paper_id}.pdf", None)
            continue
        best = None
        for file in sorted(files):
            name = plain(re.sub(r"\.[^.]*$", "", file))
            if not name or not plain(title):
                continue
            score = SequenceMatcher(None, plain(title), name).ratio() + (0.25 if plain(title) in name else 0)
            if best is None or score > best[1]:
                best = file, score
        out[paper_id] = best if best and best[1] >= 0.55 else (None, None)
    return out


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        text[r.randrange(len(text))] = r.choice("abcdefgh xyz_-")
    return "".join(text)


def test_best_file_by_sequence_ratio_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(filematch, "TITLES_PER_BLOCK", 3)
    monkeypatch.setattr(filematch, "NAMES_PER_BLOCK", 5)
    monkeypatch.setattr(filematch, "SEED_NAMES", 2)
    r = random.Random(2)
    words = ["graph", "rank", "value", "citation", "of", "deep", "learning", "study", "a", "on", "network", "model"]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(120)]
    titles += ["", None, "x", "zq", "Ünïcode: Title!", "q" * 30, "A " * 40]
    files = {edited(r, t, r.randrange(0, 14)).replace(" ", r.choice("_ -")) + ".pdf" for t in titles if t}
    files |= {"prefix_" + t + "_v2.pdf" for t in titles[:20]} | {"".join(r.choice("qwzkv") for _ in range(12)) + ".pdf" for _ in range(30)}
    files |= {"Source_5.pdf", ".pdf", "---.pdf", "no suffix graph rank", " ".join(words * 5) + " " + titles[3] + ".pdf", "b a.pdf", "a b.pdf", "a-b.txt"}
    papers = list(enumerate(titles)) + [(900, titles[1]), (901, titles[1])]
    out = fuzzy_file_matches(spark.createDataFrame([(f,) for f in files], "file_name string"), spark.createDataFrame(papers, "paper_id bigint, title string"))
    got = {x.paper_id: (x.file_name, x.score) for x in out.collect()}
    wanted = brute(files, papers)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(got[k][1] is None and v[1] is None or abs(got[k][1] - v[1]) < 1e-12 for k, v in wanted.items())
    assert sum(v[0] is not None for v in wanted.values()) > 60


def test_no_files_or_no_papers(spark):
    files, papers = spark.createDataFrame([], "file_name string"), spark.createDataFrame([(1, "some title")], "paper_id bigint, title string")
    assert [tuple(x) for x in fuzzy_file_matches(files, papers).collect()] == [(1, None, None)]
    assert fuzzy_file_matches(spark.createDataFrame([("a.pdf",)], "file_name string"), papers.limit(0)).collect() == []


def test_contained_pairs_are_those_of_all_pairs(spark):
    r = random.Random(7)
    some = lambda n, k: sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, k))) for _ in range(n)})
    parts, wholes = [*some(60, 7), ""], [*some(80, 15), "c" * 300]
    pairs = contained_pairs(spark.createDataFrame([(p,) for p in parts], "p string"), spark.createDataFrame([(w,) for w in wholes], "w string"), "p", "w")
    assert sorted(map(tuple, pairs.select("p", "w").collect())) == sorted((p, w) for p in parts if p for w in wholes if p in w)
