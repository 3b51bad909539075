"""Matches of captions, names, claims and vectors against loops."""

import itertools
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.functions import fixed
from marlpit.operators import captions, claims, decisions, entities, vector
from marlpit.plans import catalog, registry  # noqa: F401

HEAD = "| a | b |\n|:---|---|\n| 1 | 2 |"


def reconciled(spark, tables, chunks):
    got = captions.reconcile(spark.createDataFrame(tables, "table_id int, document_id int, page_number int, caption string, markdown string, _n int"), spark.createDataFrame(chunks, "document_id int, page_number int, chunk_index int, content string"))
    assert got.columns == ["table_id", "document_id", "page_number", "caption", "markdown", "_n", "reconciled_number", "original_caption"]
    return {r.table_id: (r.caption, r.reconciled_number) for r in got.collect()}


def test_captions_are_matched_when_unambiguous(spark):
    fig = "Figure 2. A plot"
    tables = [
        (1, 1, 1, fig, HEAD, 0),  # one suspect, one free number
        (2, 1, 2, fig, HEAD, 0), (3, 1, 2, "hình IV", HEAD, 0),  # two suspects
        (4, 1, 3, fig, HEAD, 0), (5, 1, 3, " Table #3: owned", "text", 0),  # of two printed numbers one is owned
        (6, 1, 4, fig, HEAD, 0),  # two free numbers
        (7, 1, None, fig, HEAD, 0), (8, 1, 5, fig, "| a |\n|---|", 0), (9, 1, 6, None, HEAD, 0), (10, 1, 7, "Figures 1", HEAD, 0), (11, 2, 1, fig, HEAD, 0),
    ]
    chunks = [
        (1, 1, 0, "Table 1: short\nwords"), (1, 1, 1, "TABLE  1.  the  longer one  \r\nTable 1x"), (1, 1, 2, "Table 1: as long as 1a"), (1, 2, 0, "Table 1: x"), (1, 3, 0, "Table 3: x\n\n  table no. 4: y"), (1, 4, 0, "Table 1: x\nTable 2: y"),
        (1, 5, 0, "Table 1: x"), (1, 6, 0, "Table 1: x"), (1, 7, 0, "Table 1: x"), (2, 9, 0, "Table 1: other page"), (None, 1, 0, "Table 1: x"), (2, 1, 0, None),
    ]
    got = reconciled(spark, tables, chunks)
    assert got.pop(1) == ("TABLE 1. the longer one", 1) and got.pop(4) == ("table no. 4: y", 4)
    assert got == {t[0]: (t[3], None) for t in tables if t[0] not in (1, 4)}
    assert reconciled(spark, [], []) == {} and reconciled(spark, tables[:1], []) == {1: (fig, None)}


def test_first_figure_text(spark):
    chunks = [(1, 0, "Fig 3 a"), (1, 1, "fig. 3: b"), (1, 2, "Fig. 3 c"), (1, 3, "FIGURE 12 d"), (2, 0, "Figure 012"), (2, 1, "a Figure 4"), (2, 2, None), (2, 3, "Fig 0"), (3, 0, "Figure " + "9" * 40)]
    figures = [(i, d, n, "old") for i, (d, n) in enumerate(itertools.product([1, 2, 3, 4, None], [0, 1, 3, 4, 9, 12, None]))]
    got = captions.figure_texts(spark.createDataFrame(figures, "i int, document_id int, figure_number int, content string"), spark.createDataFrame(chunks, "document_id int, chunk_index int, content string"))

    def loop(d, n):
        for start in ("figure ", "fig. ", "fig "):
            for doc, _, text in chunks:
                if None not in (d, n, text) and doc == d and text.lower().startswith(f"{start}{n}"):
                    return text
        return None

    assert {r.i: r.content for r in got.collect()} == {i: loop(d, n) for i, d, n, _ in figures}


def position(words, alias, prefix):
    for i in range(len(words) - len(alias) + 1):
        part = words[i : i + len(alias)]
        if part == alias:
            return i
        if prefix and part[:-1] == alias[:-1] and len(alias[-1]) >= (12 if len(alias) == 1 else 4) and len(part[-1]) > len(alias[-1]) and part[-1].startswith(alias[-1]):
            return i
    return -1


def test_inflected_mentions(spark):
    rng = random.Random(4)
    words = ["graph", "graphs", "graphics", "net", "nets", "transformation", "transformations", "transform", "of", "deep"]
    names = list({tuple(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    found = [(i % 9, " ".join(n), len(n), 3, ["filename", "filename_tail", "title", "keyword"][i % 4]) for i, n in enumerate(names)]
    asked = [(i, " ".join(rng.choices(words + ["networks", "graphical", "xtransformation"], k=rng.randint(0, 9)))) for i in range(80)] + [(99, None)]
    got = entities.mentions(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(found, "document_id int, alias string, width int, strength int, source string"))
    want = set()
    for q, text in asked:
        for _, alias, n, _, source in found:
            i = position((text or "").split(), alias.split(), source in ("filename", "filename_tail"))
            if i >= 0:
                want.add((q, alias, i, i + n))
    rows = [(r.query_id, r.alias, r.start, r.end) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def named(w):
    compact = w.replace("_", "").replace("-", "")
    if len(w) < 3 or w.lower() in fixed.UNNAMED_WORDS or w.lower() in fixed.UNNAMED_METRICS:
        return False
    if any(re.search(p, w.lower()) for p, _ in fixed.COMPOUND_NAMES) or w.lower().endswith(".pdf"):
        return True
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:[-_][A-Z0-9]+)*", w) and len(compact) >= 2:
        return True
    return bool(re.search("[A-Za-z]", w) and re.search(r"\d", w) and len(compact) >= 3 or re.search("[a-z][A-Z]", w) or "_" in w and len(compact) >= 4)


def names_of(text):
    words = [w for w in re.findall(r"\b[A-Za-z][A-Za-z0-9_.-]{1,}\b", text or "") if w.lower() not in fixed.QUESTION_WORDS]
    words += [label for p, label in fixed.COMPOUND_NAMES if re.search(p, " ".join((text or "").lower().split()))]
    out = {}
    for w in words:
        if named(w):
            out.setdefault(w.lower(), w)
    return list(out.values())[:8]


SAYINGS = [
    "What about ASPIRE and MSF-SER, or GPT4?", "the pitch fusion of Mamba-based models", "Évaluer BERTé et éGPT, le-éGPT2 X.é", "Table 2 ASPIRE please", "bài MSF-SER thì sao", "paper of the year", "see notes_v2.PDF now", "F1 ACC WA Ua sota",
    "aspire Aspire ASPIRE wav2vec 2.0", "quay lại bài báo ASPIRE", "thế còn KST?", "chuyển sang đề tài khác", "A1 A-1 A_1 ab_c aB iPhone x.y.Z", None, "", "file của report_final", "x" * 50 + "Y", "switch to X1Y2 instead", "mamba fusion", "GPT4 gpt4 Gpt4 gPt5",
    "N1 N2x N3x N4x N5x N6x N7x N8x N9x N10x",
]


def test_names_and_switches(spark):
    frame = spark.createDataFrame(list(enumerate(SAYINGS)), "i int, text string")
    got = {r.i: r.names for r in frame.select("i", decisions.entities(F.col("text")).alias("names")).collect()}
    assert got == {i: names_of(t) for i, t in enumerate(SAYINGS)}

    def switches(text, history):
        text = text or ""
        low = " ".join(text.lower().split())
        if re.search(r"\b(?:" + "|".join(fixed.RESUME_WORDS) + r")\b", low) and re.search(r"\b(?:" + "|".join(fixed.RESUMED_DOCUMENTS) + r")\b", low):
            return False
        for before in (fixed.TARGET_NOUNS, fixed.TARGET_TABLES):
            if any(named(m) for m in re.findall(rf"(?i)(?<!\w){before}({fixed.NAME_WORD})(?!\w)", text)):
                return True
        if re.search(rf"(?i)(?<!\w){fixed.DOCUMENT_FILE}(?!\w)", text):
            return True
        compact = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
        said = " ".join([history or "", *[label for p, label in fixed.COMPOUND_NAMES if re.search(p, " ".join((history or "").lower().split()))]])
        if history:
            return any(n.lower() not in said.lower() and compact(n) not in compact(said) for n in names_of(text))
        return bool(re.search(r"\b(?:" + "|".join(fixed.SWITCH_WORDS) + r")\b", low)) and bool(names_of(text))

    pairs = [(i, a, b) for i, (a, b) in enumerate(itertools.product(SAYINGS, [None, "", "user: ASPIRE and msfser", "user: mamba-based fusion", "assistant: GPT-4, KST"]))]
    both = spark.createDataFrame(pairs, "i int, a string, b string")
    got = {r.i: r.s for r in both.select("i", decisions.topic_switch(F.col("a"), F.col("b")).alias("s")).collect()}
    want = {i: switches(a, b) for i, a, b in pairs}
    assert got == want and 10 < sum(want.values()) < len(want) - 10


def test_recent_turns(spark):
    rows = [(1, i, "user" if i % 2 else None, t) for i, t in enumerate(["a", "b  c", None, " ", "d" * 1000, "e" * 500, "f" * 50, "g", "h"])] + [(2, 0, "user", "x")]
    got = {(r.conv_id, r.turn): r.history for r in decisions.recent(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    line = lambda i: f"{'user' if i % 2 else 'message'}: {' '.join((rows[i][3] or '').split())}"

    def loop(i):
        used, kept = 0, []
        for j in range(i - 1, max(i - 7, -1), -1):
            if (rows[j][3] or "").strip():
                used += len(line(j))
                if used > 1600:
                    break
                kept.insert(0, line(j))
        return "\n".join(kept) or None

    assert got == {(1, i): loop(i) for i in range(9)} | {(2, 0): None}


def test_claims_with_qualifiers_and_owners(spark):
    rng = random.Random(8)
    some = lambda names: rng.sample(names, rng.randint(0, len(names)))
    values = ["0.5", "50", "0.005", "0.7", "70.0"]
    quals, subs = ["q1", "q2", "q3", "q4"], ["paper", claims.PROPOSED, "other", claims.BASELINE]
    say = lambda i: (i, rng.choice(["f1", "acc", None]), rng.choice([*values, None]), rng.choice([True, False, None]), some(quals) if rng.random() < 0.9 else None, some(subs)[:2])
    said = [say(i) for i in range(400)] + [(None, "f1", "0.5", False, [], [])]
    proof = [(*say(0)[1:], rng.choice([["paper"], [], None])) for _ in range(60)]

    def fits(a, e):
        (m, v, p, q, s), (m2, v2, p2, q2, s2, d) = a, e
        v, v2 = Decimal(v or 0), Decimal(v2 or 0)
        if m is None or m != m2 or not (v == v2 or (bool(p) != bool(p2) and (v == v2 * 100 or v2 == v * 100))) or (q and q2 and not set(q) <= set(q2)):
            return False
        s, s2, d = set(s), set(s2), set(d or [])
        if claims.PROPOSED in s:
            return s - {claims.PROPOSED} - d <= s2 and bool(claims.PROPOSED in s2 or s2 & d)
        if s:
            return s - d <= s2 if s - d else bool(s2 & d or claims.PROPOSED in s2)
        if claims.BASELINE in s2:
            return False
        return claims.PROPOSED in s2 or (bool(s2 & d) if d else not s2)

    kind = "metric string, value decimal(38,8), percent boolean, qualifiers array<string>, subjects array<string>"
    dec = lambda r, at: tuple(Decimal(x) if i == at and x is not None else x for i, x in enumerate(r))
    a = spark.createDataFrame([dec(r, 2) for r in said], f"id int, {kind}")
    e = spark.createDataFrame([dec(r, 1) for r in proof], f"{kind}, identity array<string>")
    want = {r[0]: r[2] is not None and any(x[1] is not None and fits(r[1:], x) for x in proof) for r in said if r[0] is not None}
    got = claims.supported_by(a, e, ["id"])
    assert {r.id: r.supported for r in got.collect() if r.id is not None} == want and 20 < sum(want.values()) < 380
    assert [r.supported for r in got.where("id IS NULL").collect()] == [False]
    assert claims.supported_by(a, e.limit(0), ["id"]).where("supported").count() == 0 and claims.supported_by(a.limit(0), e, ["id"]).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_of_many(spark, monkeypatch, metric):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 6)).round(1)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), f"k{i % 3}") for i, v in enumerate(x)] + [(300, [0.0] * 6, "k0"), (301, None, "k0"), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0], "k1"), (303, [1.0, 2.0], "k1"), (304, [], "k1"), (None, [1.0] * 6, "k1"), (305, [1.0] * 6, None)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, kind string")
    asked = frame.where("id % 10 = 0 OR id = 303").select(F.col("id").alias("query_id"), F.col("v").alias("q"))

    def score(a, b):
        if metric == "l2":
            return round(float(((a - b) ** 2).sum()), 4)
        size = 1.0 if metric == "dot" else np.sqrt((a**2).sum() * (b**2).sum())
        return round(float(a @ b / size), 4) if size else 0.0

    sound = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and v and None not in v]
    for by, own in ((None, True), ("kind", False)):
        want = {}
        for q, a, _ in sound:
            if q % 10 == 0 or q == 303:
                for group in {k if by else "" for *_, k in sound}:
                    near = sorted(((score(a, b) if metric == "l2" else -score(a, b)), i) for i, b, k in sound if len(a) == len(b) and (not by or k == group) and (own or i != q))
                    want |= {(q, group, n + 1): (i, s) for n, (s, i) in enumerate(near[:4])}
        got = vector.nearest_each(frame.where("kind IS NOT NULL") if by else frame, asked, "id", "v", 4, metric, None, 4, by, own).collect()
        want = {k: v for k, v in want.items() if k[1] is not None}
        assert {(r.query_id, r.kind if by else "", r["rank"]): r.id for r in got} == {k: i for k, (i, _) in want.items()}
        assert all(abs(r.score - (want[r.query_id, r.kind if by else "", r["rank"]][1] * (1 if metric == "l2" else -1))) < 2e-4 for r in got)
    assert vector.nearest_each(frame.limit(0), asked, "id", "v", 4, metric).count() == 0


def folded(text):
    import unicodedata

    return re.findall("[a-z0-9]+", "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).casefold())


def aliases_of(filename, title, guess, keywords):
    """What a document may be called, candidate by candidate."""
    generic, weak, small = set(fixed.GENERIC_NAMES), set(fixed.WEAK_KEYWORDS), set(fixed.GRAMMATICAL)
    stem = re.sub(r"(?<=.)\.[^.]*$", "", (filename or "").rsplit("/", 1)[-1]).strip()
    title, guess = (title or "").strip(), (guess or "").strip()
    distinctive = lambda w: len(w) >= 3 and len("".join(w)) >= 12 and w[0] not in small and w[-1] not in small and (len(w) >= 4 or any(x not in small | generic for x in w))

    def safe(w, short):
        text = "".join(w)
        if not w or len(text) < (3 if short else 4) or text in generic:
            return False
        return len(w) == 1 or (short and len(text) >= 6) or any(len(x) >= 3 and x not in generic for x in w)

    out = [(stem, True, "filename")] if stem else []
    tokens = re.findall("[A-Za-z0-9]+", stem)
    upper = lambda t: sum(c.isupper() for c in t)
    for t in tokens:
        if len(t) >= 3 and sum(c.isalpha() for c in t) >= 2 and (any(c.isdigit() for c in t) or upper(t) >= 2) and (not t.isupper() or len(t) <= 6) and t.lower() not in weak | generic:
            out.append((t, True, "filename_token"))
    for i, t in enumerate(tokens):
        if len(t) >= 3 and upper(t) >= 2 and t.lower() not in weak | generic:
            tail = list(itertools.takewhile(lambda x: x in fixed.COMPOUND_TAILS, map(str.lower, tokens[i + 1 : i + 5])))
            out += [(" ".join([t.lower(), *tail[: n + 1]]), True, "filename_compound") for n in range(len(tail))]
            if matter := [x for x in tail if x not in fixed.REMOVABLE_TAILS]:
                out.append((" ".join([t.lower(), *matter]), True, "filename_compound"))
    words = folded(stem)
    out += [(" ".join(words[a:b]), False, "filename_phrase" + "_tail" * (b == len(words))) for a in range(len(words)) for b in range(a + 3, len(words) + 1) if distinctive(words[a:b])]
    out += [(t, False, "title") for t in (title, guess) if t]
    context = f"{stem} {title} {guess}"
    flat, known = re.sub("[^a-z0-9]+", "", context.lower()), folded(context)
    initials = "".join(w[0] for w in known if w not in small)
    for k in keywords or []:
        w = folded(k)
        if len("".join(w)) < 3:
            continue
        if len(w) >= 2:
            heads = w[0] + "".join(x[0] for x in w[1:])
            ok = "".join(w) in flat or (len(heads) >= 3 and heads in known)
        else:
            ok = w[0] not in weak | generic and len(w[0]) <= 12 and (w[0] in flat if re.search(r"\d", w[0]) else 3 <= len(w[0]) <= 10 and w[0] in initials)
        if ok:
            out.append((k.strip(), False, "keyword"))
    best = {}
    for raw, short, source in out:
        w = tuple(folded(raw))
        free = source.startswith("filename_phrase") and distinctive(w)
        for form in [w, ("".join(w),)] if free or safe(w, short) else []:
            if (form == w or (len(w) > 1 and (free or safe(form, short)))) and fixed.ALIAS_STRENGTH[source] > best.get(form, (0,))[0]:
                best[form] = (fixed.ALIAS_STRENGTH[source], source)
    return {(" ".join(w), len(w), *v) for w, v in best.items()}


def test_catalog_aliases(spark):
    rows = [
        ("MSF-SER_based fusion model.pdf", "Multi Scale Fusion", "A study of the graph", ["ser", "MSF", "msf-ser", "GNN5", "a b", "scale"]), ("KST-Transformer of speech emotion recognition.docx", "", None, ["KS-Transformer", "kst", "dataset"]),
        ("from_the_garden_to_the_table.txt", "Über Größe", "đường đi", ["ggt", None, " "]), ("plan.md", "project", "ab", []), (None, None, None, None), (".hidden", "x", "", ["x1y2z3"]), ("a/b/ASPIRE2 network framework system method model.v2.pdf", "ASPIRE", "", ["aspire2"]),
        ("LONGUPPERCASE Wav2Small.pdf", "Language Pattern Mixed Network", "", ["lpmn", "LPM", "wav2small", "toolongkeyword1"]), ("one two three.pdf", "in of the", "multi label single text", []), ("C3PO and R2D2 using visual audio.pdf", None, None, ["C3-PO", "rd"]),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "document_id int, filename string, title string, title_guess string, keywords array<string>")
    got = {}
    for r in entities.catalog_aliases(frame).collect():
        got.setdefault(r.document_id, []).append((r.alias, r.width, r.strength, r.source))
    for i, r in enumerate(rows):
        assert set(got.get(i, [])) == aliases_of(*r) and len(got.get(i, [])) == len(set(got.get(i, []))), r
    assert sum(map(len, got.values())) > 60


def test_catalog_aliases_are_made_by_as_many_tasks_as_documents_need(spark, monkeypatch):
    """A task makes the names of some documents only, however few bytes or files they come in, and no second shuffle gathers them."""
    frame = spark.range(60).coalesce(1).selectExpr("id AS document_id", "concat('KX', id, '_fusion model of speech.pdf') AS filename", "'A title here' AS title", "'' AS title_guess", "array('KX1', 'kx-fusion') AS keywords")
    rows = lambda f: sorted(map(tuple, f(frame).collect()))
    want = rows(entities.catalog_aliases), rows(entities.aliases)
    monkeypatch.setattr(entities, "DOCUMENTS", 5)
    for made, before in zip((entities.catalog_aliases, entities.aliases), want, strict=True):
        assert rows(made) == before and made(frame).rdd.getNumPartitions() == 12
    assert entities.catalog_aliases(frame)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_texts_are_matched_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """Few bytes of texts, in one file, are dealt to tasks of some texts each; a null text and equal ones give what they gave."""
    asked = spark.range(60).coalesce(1).selectExpr("id AS query_id", "CASE WHEN id % 4 < 3 THEN concat('what is ring ', id % 30, ' like') END AS text")
    names = spark.createDataFrame([(i, f"ring {i}", 2, 3, "filename") for i in range(30)], "document_id int, alias string, width int, strength int, source string")
    want = {(i, f"ring {i % 30}", 2, 4, 1) for i in range(60) if i % 4 < 3}
    for counts in (False, True):
        got = entities.mentions(asked, names, counts=counts).withColumn("n", F.col("n_owners") if counts else F.size("owners")).select("query_id", "alias", "start", "end", "n").collect()
        assert set(map(tuple, got)) == want and len(got) == len(want)
    monkeypatch.setattr(entities, "DOCUMENTS", 5)
    found = entities.mentions(asked, names, counts=True)
    assert found.count() == len(want) and "(_text#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and ", 7\n" in plan, plan


def test_mentions_of_names_with_many_owners(spark):
    """Rows don't bring the owners of their alias, and owners are compared as the general form compares them."""
    names = [(i, f"{'big' if i % 3 else 'small'} ring {'left' if i % 2 else 'right'}", 3 - i % 2) for i in range(12)] + [(i, "ring", 1 + i % 3) for i in range(0, 12, 2)]
    names += [(i, "small ring", 2) for i in range(0, 12, 3)] + [(20, "ring left", 3), (1, "big", 1), (2, "big", 2)]
    names = spark.createDataFrame(names, "document_id int, alias string, strength int").withColumn("source", F.lit("filename"))
    texts = ["what is big ring left", "small ring right or small ring left", "a ring and a big thing", None, ""]
    asked = spark.createDataFrame([(i, texts[i % 5]) for i in range(40)], "query_id int, text string")
    whole, counted = entities.mentions(asked, names), entities.mentions(asked, names, counts=True)
    both = [whole.withColumn("n_owners", F.size("owners")).drop("owners"), counted]
    want, got = ({tuple(r.asDict()[c] for c in ("query_id", "alias", "start", "end", "strength", "n_owners")) for r in x.collect()} for x in both)
    assert want == got and len(got) == counted.count() > 40
    shown = ["query_id", "alias", "start", "end"]
    want, got = (sorted(map(tuple, x.select(shown).collect())) for x in (entities.unshadowed(whole), entities.unshadowed(counted, owned=names)))
    assert want == got and 0 < len(got) < counted.count()
    for name in ("j16_mentions", "j17_unshadowed", "j16_inflected_mentions"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan
