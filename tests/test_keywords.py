"""Stems, keyword rank and retrieval against plain versions."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stem, text as x
from sparkloom.operators import keywords as kw
from sparkloom.plans import retrieval as r

#: Word and stem pairs of the published sample vocabulary and of English usage.
SAMPLE = """consignment consign consistently consist consolations consol consolidate consolid consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl
constancy constanc knackeries knackeri knavish knavish kneeling kneel knives knive knightly knight knopp knopp refunds refund refunded refund generally general generate generat generous generous
communism communism community communiti ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri bled bled agreed agre feed feed dying die inning inning
succeed succeed happy happi by by relational relat conditional condit triplicate triplic formative format formalize formal hopeful hope goodness good allowance allow adjustable adjust replacement replac
adoption adopt probate probat rate rate controll control youth youth boyish boyish flying fli syzygy syzygi analogies analog 1990s 1990s yes yes says say enjoyed enjoy""".split()


def plain_stem(w):
    """Porter2 from its published description, step by step on strings."""
    if len(w) <= 2 or any(c.isdigit() for c in w):
        return w
    if w in stem.OWN_STEM or w in stem.UNCHANGED:
        return stem.OWN_STEM.get(w, w)
    vowels = "aeiouy"
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in vowels and not (w[i - 1] == "y" and (i == 1 or w[i - 2] in vowels))) else c for i, c in enumerate(w))

    def region(s, at):
        for i in range(at + 1, len(s)):
            if s[i] not in vowels and s[i - 1] in vowels:
                return i + 1
        return len(s)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(w, 0)
    r2 = region(w, r1)

    def short(s):
        return len(s) == 2 and s[0] in vowels and s[1] not in vowels or len(s) > 2 and s[-3] not in vowels and s[-2] in vowels and s[-1] not in vowels + "wxY"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w in stem.DONE_EARLY:
        return w.replace("Y", "y")
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if suffix in ("eed", "eedly"):
                w = rest + "ee" if len(rest) >= r1 else w
            elif any(c in vowels for c in rest):
                w = rest
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                    w = w[:-1]
                elif r1 >= len(w) and short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    for table, at in ((stem.STEP_2, r1), (stem.STEP_3, r1), (dict.fromkeys(stem.STEP_4, ""), r2)):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                rest = w[: -len(suffix)]
                good = len(rest) >= at and not (suffix == "ative" and len(rest) < r2)
                good &= {"ogi": rest.endswith("l"), "li": rest[-1:] in set("cdeghkmnrt"), "ion": rest[-1:] in ("s", "t")}.get(suffix, True)
                w = rest + table[suffix] if good else w
                break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def test_stems(spark):
    pairs = dict(zip(SAMPLE[::2], SAMPLE[1::2]))
    assert {w: plain_stem(w) for w in pairs} == pairs
    path = "/root/testdata/sf0.001/documents.parquet"
    words = {w for (t,) in duckdb.sql(f"SELECT text FROM '{path}'").fetchall() for w in re.findall(r"[^\W_]+", t.lower())}
    rng = random.Random(4)
    ends = [*stem.STEP_2, *stem.STEP_3, *stem.STEP_4, "ed", "ing", "eed", "ingly", "s", "ies", "y", "e", "ll", "sses"]
    words |= {"".join(rng.choice("aeiouybcdlmrstz") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) + rng.choice(["", "s", "ly", "ed"]) for _ in range(6000)} | set(pairs)
    frame = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = {q.word: q.stem for q in stem.stems(frame).collect()}
    assert got == {w: plain_stem(w) for w in words}
    with duckdb.connect() as con:
        con.execute("CREATE TABLE v AS SELECT unnest(?) AS word", [sorted(words)])
        assert dict(con.execute(f"WITH {stem.stems_sql('v', 's')} SELECT * FROM s").fetchall()) == got


def covers(entries, wanted):
    """Cover density by trying every span: the shortest that hold all of wanted."""
    spans = [(p, q) for p in {e[0] for e in entries} for q in {e[0] for e in entries} if p <= q and {s for a, s, _ in entries if p <= a <= q} >= set(wanted)]
    least = [(p, q) for p, q in spans if not any((a, b) != (p, q) and p <= a and b <= q for a, b in spans)]
    total = 0.0
    for p, q in least:
        inside = [w for a, _, w in entries if p <= a <= q]
        total += len(inside) / sum(1 / w for w in inside) / (1 + (q - p) - (len(inside) - 1))
    return total


def test_keyword_hits(spark):
    """Any of several terms, or every word of a question without terms, against plain counting and plain covers."""
    rng = random.Random(7)
    words = "refund refunds refunded tie ties go to it ok is shipping ships x y".split()
    chunks = [(d, p, " ".join(rng.choices(words, k=rng.randrange(0, 30))), " ".join(rng.choices(words, k=rng.randrange(0, 4)))) for d in range(20) for p in range(3)]
    chunks.append((99, 0, "refund " * 400, ""))
    frame = spark.createDataFrame(chunks, "doc_id long, position int, content string, title string")
    frame = frame.select("*", x.tokens(F.col("content"), 1).alias("words"), x.tokens(F.col("title"), 1).alias("title_words"))
    asked = [(1, "refunding a tie", ["refunding", "tie"]), (2, "go ok", []), (3, "x y x", []), (4, "is to", []), (5, "the", ["the"]), (6, "go", [])]
    got = {(q.item_id, q.doc_id, q.position): (q.m, q.n, round(q.density, 9)) for q in kw.keyword_hits(frame, spark.createDataFrame(asked, "item_id long, text string, terms array<string>"), ["doc_id", "position"]).collect()}
    want = {}
    for item, said, terms in asked:
        stems_ = {plain_stem(w) for w in (terms or set(said.split())) if w not in stem.STOP_WORDS}
        for d, p, content, title in chunks:
            places = [(k, plain_stem(w), 1.0) for k, w in enumerate(title.split(), 1)]
            places += [(k + len(places), plain_stem(w), 0.4) for k, w in enumerate(content.split(), 1)]
            own = [e for e in places if e[1] in stems_]
            m, n = Counter(s for _, s, w in own if w == 1), Counter(s for _, s, w in own if w != 1)
            m, n = sum(min(v, 255) for v in m.values()), sum(min(v, 255) for v in n.values())
            if terms and own:
                want[item, d, p] = (m, n, round(m + 0.4 * n, 9))
            elif not terms and stems_ and {e[1] for e in own} == stems_:
                want[item, d, p] = (sum(w == 1 for _, _, w in own), sum(w != 1 for _, _, w in own), round(covers(own, stems_), 9))
    assert got == want and len(got) > 60


def test_question_blocks(spark):
    """Questions in many blocks get the rows that one block gives."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    chunks = spark.createDataFrame([(d, p, [rng.choice(words) for _ in range(8)]) for d in range(90) for p in range(2)] + [(1000, 0, []), (1001, 0, ["a"])], "doc_id long, position int, words array<string>").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(rng.choices(words, k=3))) for k in range(50)] + [(99, "")], "item_id long, text string")

    def best(block):
        found = {}
        for q in r.vector_leg(asked, chunks, block).collect():
            found.setdefault(q.item_id, []).append((-q.score, q.doc_id, q.position))
        return {k: sorted(v)[: r.LEGS[0]] for k, v in found.items()}

    one = best(r.BLOCK)
    assert one == best(7) == best(1) and set(one) == set(range(50)) and all(len(v) == r.LEGS[0] for v in one.values())


#: Titles and texts of pages whose order for a question is to hold.
PAGES = [
    ("Time Calculator", "Add or subtract hours, minutes and seconds. Total seconds equals days times 86400 plus hours times 3600."),
    ("Time Duration Calculator", "Calculate the duration between two times in hours minutes and seconds. Useful for tracking project work, shift logs and flight times. Duration equals end time minus start time."),
    ("Study Time Calculator", "Plan revision hours across subjects and work out how much time each topic needs before an exam date."),
    ("Screen Time Calculator", "Work out how many hours of screen time you spend each day across phone, laptop and television."),
    ("Raspberry Pi Camera Project", "Build a motion sensing camera. Wire the module to the port and enable the interface."),
    ("Raspberry Pi Weather Station Project", "Log temperature humidity and pressure from a sensor and publish readings to a dashboard."),
    ("Network Time Server", "Sync clocks over the network from a satellite module."),
]


def test_retrieve(spark):
    """The page that a question names comes first, inflected words find it, and copies take one place."""
    chunks = [(k, 0, t, f"{t}. {b}") for k, (t, b) in enumerate(PAGES)] + [(6, p, PAGES[6][0], ". ".join(PAGES[6])) for p in (1, 2)]
    index = r.indexed(spark.createDataFrame(chunks, "doc_id long, position int, title string, content string"))
    # hashed vectors weigh every word, so the question leaves out the words that a trained encoder would not weigh
    asked = ["time calculator", "time duration calculator", "what raspberry pi camera projects do you have", "raspberry pi weather station project", "network time server", "subtracting minutes", "sensing motions"]
    hits = r.retrieve(spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), index).collect()
    first = {h.item_id: h for h in hits if h.place == 1}
    assert [first[k].doc_id for k in range(7)] == [0, 1, 4, 5, 6, 0, 4]
    assert first[3].confidence > 300_000
    assert sum(h.item_id == 4 and h.doc_id == 6 for h in hits) == 1
