import random

from rows import docs_of

from skillbridge.llm import decontam

QUESTION = (
    "A farmer named Hopkins sells 14 melons for 3 dollars each on market day and then Hopkins "
    "gives 14 coins to the miller who lives near the old stone bridge behind the village"
)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(spark, rows, items, **kw):
    out = decontam.matches(docs_of(spark, rows), bench(spark, items), **kw).collect()
    return {(r.doc_id, r.item_id): r for r in out}


def filler(rng, count):
    return " ".join(rng.choice(["alder", "birch", "cedar", "maple", "oak", "pine", "yew"]) for _ in range(count))


def test_copies_and_new_parameters(spark):
    rng = random.Random(1)
    same = f"{filler(rng, 30)}. {QUESTION}. {filler(rng, 300)}"
    renamed = QUESTION.replace("Hopkins", "Barlow").replace("14", "230").replace(" 3 ", " 9 ").replace("dollars", "euros")
    clash = QUESTION.replace("Hopkins sells 14", "Barlow sells 230").replace("gives 14", "gives 77")
    rows = [
        (1, same),
        (2, f"{filler(rng, 9)}\n{renamed} {filler(rng, 50)}"),
        (3, clash),
        (4, filler(rng, 400)),
        (5, QUESTION.upper()),
        (6, " ".join(QUESTION.split()[:12])),
        (7, " ".join(QUESTION.split()[:15])),
        (8, None),
        (9, ""),
        (1, same),
        (None, same),
        (10, " ".join(clash.split()[:19])),
    ]
    got = found(spark, rows, [(70, QUESTION), (71, None), (72, ""), (73, "too few words"), (70, QUESTION), (None, QUESTION)])
    hits = {d for d, i in got if i == 70}
    assert {1, 2, 3, 5, 7, None} <= hits and not hits & {4, 6, 8, 9}
    assert {(d, None) for d in hits} <= set(got)
    assert got[1, 70].exact and not got[2, 70].exact and got[2, 70].n_slots >= 3
    # a value that the item repeats must be repeated; what is equal word by word stands all the same
    assert 10 not in hits and got[3, 70].exact


def test_other_case_and_names_at_the_start(spark):
    german = "der Müller aus Straßburg geht über die große Brücke und Élodie grüßt ihn dort sehr höflich"
    named = "Hopkins sells 14 melons for 3 dollars each on market day near town"
    renamed = "Barlow sells 90 melons for 5 dollars each on market day near town"
    rows = [(5, QUESTION.upper()), (6, QUESTION.title()), (7, german.upper()), (8, renamed), (9, f"Later on Barlow{renamed[6:]}")]
    got = found(spark, rows, [(70, QUESTION), (71, german), (72, named)])
    assert set(got) == {(5, 70), (6, 70), (7, 71), (8, 72), (9, 72)}
    assert all(got[k].exact for k in [(5, 70), (6, 70), (7, 71)]) and not got[8, 72].exact and got[8, 72].n_slots == 4


def test_items_of_few_plain_words_match_word_by_word(spark):
    sum_of = "What is 12 plus 30 ?"
    table = "12 kg 30 kg 45 kg 7 Barlow 8 Hopkins 9 Miller 10"
    rows = [(1, f"he asked: {sum_of}"), (2, "What is 12 plus 31 ?"), (3, f"seen {table} there"), (4, table.replace("45", "46"))]
    got = found(spark, rows, [(70, sum_of), (71, table)])
    assert set(got) == {(1, 70), (3, 71)} and all(r.exact for r in got.values())


def brute(rows, items, window):
    """Pairs that share a window of equal words, for texts without any slots."""
    def grams(text, n):
        words = (text or "").lower().split()
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    out = set()
    for i, item in items:
        n = min(window, len((item or "").split()))
        if n < decontam.SHORTEST:
            continue
        mine = grams(item, n)
        out |= {(d, i) for d, text in rows if mine & grams(text, n)}
    return out


def test_plain_words_as_by_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [a + b for a in "bcdfg" for b in ("ah", "el", "im")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([3, 5, 6, 9, 13, 14, 40]))) for k in range(40)]
    rows = []
    for k in range(150):
        words = text(rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            words[len(words) // 2 : len(words) // 2] = part[a : a + rng.randrange(1, 41)] if rng.random() < 0.5 else part
        rows.append((k, " ".join(words)))
    rows.append((900, text(200_000)))
    for window in (6, 13):
        assert set(found(spark, rows, items, window=window)) == brute(rows, items, window)


def test_filter(spark):
    rng = random.Random(6)
    rows = [(1, QUESTION), (2, filler(rng, 50)), (2, QUESTION), (3, None), (3, None), (4, "")]
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "window", "source": "item_id"})
    kept = decontam.remove_contaminated(docs, bench(spark, [(1, QUESTION)]))
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r) for r in [rows[1], *rows[3:]])
    assert decontam.remove_contaminated(docs, bench(spark, [])).count() == 6
    assert decontam.matches(docs_of(spark, []), bench(spark, [(1, QUESTION)])).count() == 0


def test_workers_give_memory_back_while_they_make_windows(spark, monkeypatch):
    worked = []
    monkeypatch.setattr(decontam, "tidied", lambda work: worked.append(work) or work)
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "One two three four five six")], "item_id long, text string")
    assert [r.item_id for r in decontam.matches(docs, items).collect()] == [7]
    assert len(worked) == 1
