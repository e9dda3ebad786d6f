import random
import re
from itertools import product

import pytest

from weftline.llm import decontam

SF = "/root/testdata/sf0.01"
Q = "A train leaves Paris at 40 km per hour while Anna waits 3 hours and reads 12 pages of her longest book before the bell rings twice"


def plain_words(text):
    return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (text or "").split()) if w]


def found(spark, docs, items):
    docs = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, pos int, hash long, slots string")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, windows int")
    return {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, items).collect()}


def test_verbatim_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = {}
    for r in items.collect():
        w = plain_words(r.text)
        windows[r.item_id] = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for r in docs.collect():
        w = plain_words(r.text)
        mine = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want |= {(r.doc_id, i) for i, x in windows.items() if x and sum(y in mine for y in x) >= 0.8 * len(x)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).filter("kind = 'verbatim'").collect()}
    assert got == want and len(want) > 5


@pytest.mark.parametrize(
    "text,kind",
    [
        (Q, "verbatim"),
        (Q.upper().replace(" ", "  \n"), "verbatim"),
        (re.sub("Paris", "Rome", Q.replace("40", "55").replace("Anna", "Clara").replace("12", "7").replace(" 3 ", " 9 ")), "template"),
        (Q.replace("40 km", "40km"), "verbatim"),
        (Q.replace("longest book before", "oldest song after"), None),
        (" ".join(Q.split()[:10]), None),
        ("nothing of the kind is in this text at all, only other words that go on for a while", None),
    ],
)
def test_kinds(spark, text, kind):
    noise = "Before it. " + " ".join(f"w{i % 7}x" for i in range(300))
    got = found(spark, [(7, f"{noise}. {text}. {noise}")], [(3, Q)])
    assert got == ({(7, 3): kind} if kind else {})


def test_slots_have_to_be_consistent(spark):
    """Every window fits as a template, but the two places of one number have different numbers."""
    item = "take 5 red apples from the box and put 5 green pears back then give 5 ripe plums to your friend who likes 5 kinds of fruit"
    values = iter("6789")
    docs = [(1, item.replace("5", "8")), (2, "".join(next(values) if c == "5" else c for c in item))]
    assert found(spark, docs, [(1, item)]) == {(1, 1): "template"}


def test_odd_tables(spark, odd_documents, no_documents):
    items = [(1, "same words here and there but not in this place"), (2, None), (3, ""), (4, "two words"), (5, Q), (6, Q.upper()), (None, "x y z u v w")]
    docs = [(1, None), (2, ""), (None, Q), (3, Q), (3, Q), (3, Q + " tail"), (4, " ".join(["filler"] * 50_000) + " " + Q)]
    # Equal items are one; equal rows are one document.
    assert found(spark, docs, items) == {(None, 5): "verbatim", (3, 5): "verbatim", (4, 5): "verbatim"}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text or "") for r in decontam.remove_contaminated(frame, table).collect()) == [("1", ""), ("2", "")]
    assert decontam.remove_contaminated(odd_documents, table).count() == odd_documents.count()
    assert decontam.remove_contaminated(no_documents, table).columns == no_documents.columns


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BITS", 64)
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(20))) for i in range(30)]
    got = found(spark, [(i, f"x y {t} z") for i, t in items[::3]], items)
    assert set(got) == {(i, i) for i, _ in items[::3]}


def test_names_that_open_sentences(spark):
    item = "Anna has 12 apples and gives 5 of them away. Tom has 7 pears and buys 4 more of them. How many pieces of fruit do they have now?"
    other = item.replace("Anna", "Clara").replace("Tom", "Erik").replace("12", "31").replace("7", "8")
    assert found(spark, [(1, f"Some text. {other} More text."), (2, item.replace(". How", " and how").replace("12", "31"))], [(1, item)]) == {(1, 1): "template", (2, 1): "template"}


def test_questions_dense_in_numbers(spark):
    items = [(1, "Compute 12 + 7 + 30 + 5 + 9 and give the sum"), (2, "what is then 12 7 30 5 9 3"), (3, "sum 12 7 30 5 9 total")]
    texts = ["Compute 31 + 8 + 44 + 6 + 2 and give the sum", "what is then 31 8 44 6 2 1", "sum 31 8 44 6 2 total"]
    docs = [(i, f"some words here, {t} more words there") for i, t in enumerate(texts, 1)]
    docs += [(9, " ".join(str(i) for i in range(3000))), (10, "Compute 31 + 8 + 44 + 6 + 2 or leave it")]
    assert found(spark, docs, items) == {(i, i): "template" for i in (1, 2, 3)}


def test_units_stand_beside_numbers():
    import pyarrow as pa

    slots = [s for _, _, _, s in decontam.scan(pa.array(["we sat in a boat that it was t or s for them"]), None)]
    assert slots and not any(slots)
    assert any(s == "12\x1f2km" for _, _, _, s in decontam.scan(pa.array(["it ran 2 km away from us"]), None))


def test_every_occurrence_is_judged_by_itself(spark):
    """Two changed versions of one item in a document: each alone is consistent, their values mixed are not."""
    one = Q.replace("Paris", "Rome").replace("40", "55").replace("Anna", "Clara").replace("12", "7").replace(" 3 ", " 9 ")
    two = Q.replace("Paris", "Oslo").replace("40", "21").replace("Anna", "Erika").replace("12", "8").replace(" 3 ", " 4 ")
    # Votes that the smallest string wins are dealt to both versions.
    three = Q.replace("Paris", "Zagreb").replace("40", "11").replace("Anna", "Aida").replace("12", "99").replace(" 3 ", " 1 ")
    docs = [(1, f"{one}. {two}."), (2, f"{one}. {three}."), (3, f"{three} and so on. {two}. {one}.")]
    assert found(spark, docs, [(3, Q)]) == {(i, 3): "template" for i in (1, 2, 3)}


def test_short_items(spark):
    docs = [(1, "well, the quick Fox ran"), (2, "quick the fox"), (3, "one"), (4, "say one thing"), (5, "quick fox"), (6, None), (7, "the quick. fox jumps over it all day and night")]
    items = [(1, "The quick fox"), (2, "one"), (3, "..."), (4, "over it all day"), (5, ""), (6, "it all day and night")]
    assert found(spark, docs, items) == {(1, 1): "verbatim", (7, 1): "verbatim", (3, 2): "verbatim", (4, 2): "verbatim", (7, 4): "verbatim", (7, 6): "verbatim"}
    # Items shorter than a window change nothing for the others.
    assert {k: v for k, v in found(spark, docs, items).items() if k[1] == 6} == found(spark, docs, items[-1:])


def brute_template(text, item):
    """(least, most) windows of five words that agree at the item's best place: under the commonest reading of its numbers, under any."""
    words, mine = text.split(), item.split()
    least = most = 0
    for at in range(len(words) - len(mine) + 1):
        part = words[at : at + len(mine)]
        votes = {}
        for a, b in zip(mine, part):
            if a.isdigit() and b.isdigit():
                votes.setdefault(a, []).append(b)

        def agree(reading):
            ok = [reading.get(a) == b if a.isdigit() and b.isdigit() else a == b for a, b in zip(mine, part)]
            return sum(all(ok[i : i + 5]) for i in range(len(mine) - 4))

        commonest = {a: v[0] if len(set(v)) == 1 else max(set(v), key=v.count) for a, v in votes.items()}
        clear = all(sorted(map(v.count, set(v)))[-2:-1] != [v.count(commonest[a])] for a, v in votes.items())
        least = max(least, agree(commonest) if clear else 0)
        most = max([most, *(agree(dict(zip(votes, x))) for x in product(*map(set, votes.values())))])
    return least, most


def test_templates_against_brute_force(spark):
    """Items with new numbers, in one reading or in several, and with changed words, hidden in other text."""
    rng = random.Random(6)
    vocabulary = [a + b for a in ("ba", "de", "fi", "go", "lu", "mar") for b in ("ko", "lim", "nat", "per", "quo")]
    items, docs = [], []
    for i in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(14, 30))]
        for p in rng.sample(range(len(words)), 4):
            words[p] = str(rng.choice([11, 27, 35]))
        items.append((i, " ".join(words)))
        for how in ("consistent", "mixed", "word", "two"):
            reading = {x: str(rng.randrange(100, 999)) for x in ("11", "27", "35")}
            new = [reading.get(w, w) if how != "mixed" or not w.isdigit() else str(rng.randrange(100, 999)) for w in words]
            for _ in range({"word": 1, "two": 2}.get(how, 0)):
                new[rng.randrange(len(new))] = "changed"
            around = [[rng.choice(vocabulary) + "x" for _ in range(rng.randrange(3, 20))] for _ in range(2)]
            docs.append((len(docs), " ".join(around[0] + new + around[1])))
    least, most = set(), set()
    for d, text in docs:
        for i, item in items:
            k = len({tuple(item.split()[j : j + 5]) for j in range(len(item.split()) - 4)})
            for n, into in zip(brute_template(text, item), (least, most)):
                if n >= 0.8 * k:
                    into.add((d, i))
    got = set(found(spark, docs, items))
    assert least <= got <= most and 12 < len(least) <= len(most) < len(docs)
