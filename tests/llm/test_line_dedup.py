import random
import re

from samples import DOCS, prose

from stressloom.llm import line_dedup


def brute(rows, run=line_dedup.RUN):
    """(doc_id, text) -> (text, lines removed): a line goes if it lies in a stretch of lines with `run` words or more that occurred before."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows)):
        raw = text.encode()
        cuts = [0, *(m.end() for m in re.finditer(rb"\n|[.!?]\x20", raw)), len(raw)]
        lines = []
        for a, b in zip(cuts, cuts[1:]):
            w = tuple(re.findall(rb"[^\x20\x09-\x0d]+", raw[a:b].lower()))
            if w and (not lines or lines[-1][1]):
                lines.append([raw[a:b], w])
            elif lines:
                lines[-1] = [lines[-1][0] + raw[a:b], lines[-1][1] or w]
            else:
                lines.append([raw[a:b], w])
        gone = set()
        for p in range(len(lines)):
            n, q = 0, p
            while q < len(lines) and n < run:
                n, q = n + len(lines[q][1]), q + 1
            if n < run:
                break
            before = seen.setdefault(tuple(x[1] for x in lines[p:q]), [])
            for other, at in before:  # as far as the match goes
                k = q
                while k < len(lines) and at + k - p < len(other) and other[at + k - p][1] == lines[k][1]:
                    k += 1
                gone.update(range(p, k))
            before.append((lines, p))
        out[doc_id, text] = (b"".join(x[0] for k, x in enumerate(lines) if k not in gone).decode(), len(gone))
    return out


def pieces(rng, n, lines):
    return rng.choice(["\n", " ", "\n\n"]).join(rng.choice(lines) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(6)
    lines = [prose(rng, rng.choice([1, 2, 5, 9, 20, 60])) + rng.choice([".", "!", ""]) for _ in range(60)]
    rows = [(i, pieces(rng, rng.randint(0, 25), lines)) for i in range(150)]
    shared = ". ".join(prose(rng, 9) for _ in range(8)) + "."
    rows += [(200 + i, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    want = brute(rows)
    for r in line_dedup.dedup_lines(docs).collect():
        original = dict(rows)[r.doc_id]
        assert (r.text, r.lines_removed) == want[r.doc_id, original]


def test_matches_reach_the_last_line_that_matches(spark):
    """A run ends inside a line that is longer than the lines left behind it; a longer match with a later occurrence counts too."""
    rng = random.Random(8)
    start, long, tail = prose(rng, 3), prose(rng, 40).replace(".", ""), [prose(rng, n).replace(".", "") for n in (5, 7, 1)]
    rows = [(1, "\n".join([start, long])), (2, "\n".join([long, *tail])), (3, "\n".join(["own words", long, *tail, "more"])), (4, "\n".join([long, *tail[:2], "other", tail[2]]))]
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()}
    assert got == {i: brute(rows)[i, t] for i, t in rows}
    assert got[3] == ("own words\nmore", 4) and got[4] == ("other\n" + tail[2], 3) and got[2][1] == 1


def test_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(7)
    passage = ". ".join(prose(rng, 8).replace(".", "") for _ in range(7)) + "."
    clean = [(i, prose(rng, 120)) for i in range(20)]
    rows = clean + [(100 + i, prose(rng, 40).replace(".", "") + "\n" + passage + "\n" + prose(rng, 40)) for i in range(30)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()}
    assert all(got[i].text == t and got[i].lines_removed == 0 for i, t in clean)
    assert passage in got[100].text and not any(passage in got[100 + i].text for i in range(1, 30))


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.query(spark, sf).collect()} == {i: want[i, t] for i, t in rows}


def test_odd_rows(spark, odd, clash, none, sf):
    got = line_dedup.dedup_lines(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 4] == [r.text for r in odd.collect() if r.doc_id == 4]
    assert {r.text for r in rows if r.doc_id in (1, 2, 3)} == {None, "", " \n\t "}
    assert [r.text for r in rows if r.doc_id == 5] == [""]  # the same words as document 4
    assert line_dedup.dedup_lines(none).count() == 0
    staged = line_dedup.stage(spark, clash, sf)
    assert staged.columns == clash.columns and staged.count() == odd.count() - 1


def brute_words(rows, run=line_dedup.RUN):
    """(doc_id, text) -> text: a word goes, with the blanks behind it, if it lies in `run` words that occurred before."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(rows)):
        raw = text.encode()
        found = list(re.finditer(rb"[^\x20\x09-\x0d]+", raw))
        w, cuts = [m[0].lower() for m in found], [0, *[m.start() for m in found[1:]], len(raw)]
        gone = set()
        for p in range(len(w) - run + 1):
            if seen.setdefault(tuple(w[p : p + run]), (doc_id, p)) != (doc_id, p):
                gone.update(range(p, p + run))
        out[doc_id, text] = text if not gone else b"".join(raw[cuts[k] : cuts[k + 1]] for k in range(len(w)) if k not in gone).decode()
    return out


def test_passages_of_51_to_60_words_pasted_mid_sentence_go_whole(spark):
    rng = random.Random(8)
    rows, passages = [], []
    for k, n in enumerate(range(51, 61)):
        w = prose(rng, n).split()
        if k % 3 == 0:  # one line longer than a run
            w = [x.replace(".", "") for x in w]
        passages.append(" ".join(w))
        for j in range(4):  # the passage begins and ends inside a sentence
            around = [" ".join(x.replace(".", "") for x in prose(rng, 20).split()) for _ in range(2)]
            rows.append((10 * k + j, f"{prose(rng, 20)} {around[0]} {passages[-1]} {around[1]}. {prose(rng, 20)}"))
    some = [prose(rng, rng.choice([1, 2, 5, 9, 20, 60])) for _ in range(40)]
    rows += [(1000 + i, pieces(rng, rng.randint(0, 12), some)) for i in range(80)]
    rows += [(2000, "a " * 100), (2001, "  " + rows[0][1].upper() + " \n"), (2002, rows[0][1]), (2002, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    want = brute_words(rows)
    got = line_dedup.dedup_lines(docs, extend=True).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, want[i, t]) for i, t in rows)
    staged = {r.doc_id: r.text for r in line_dedup.stage(spark, docs, "").collect()}
    texts = dict(rows)
    for k, p in enumerate(passages):
        assert p in staged[10 * k] and all(staged[10 * k + j] == texts[10 * k + j].replace(p + " ", "") for j in (1, 2, 3))
