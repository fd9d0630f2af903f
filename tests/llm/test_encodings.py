import random

from plexora.llm import encodings as E

FR = "Le théâtre d’été près de la forêt était très agréable, à côté du café où l’équipe a préparé une crêpe".split()
DE = "Für die Straße hört man früh übers Dorf schöne Glocken, das Mädchen grüßt höflich und fröhlich".split()
RU = "Музыканты играли на рассвете и площадь стала уютной хозяин рассказал как готовят блины".split()


def test_steps_undo():
    t = "théâtre – 45 €"
    for s, (w, r) in enumerate(E.STEPS):
        if w in ("utf-8", "cp1252", "cp850") and not (w == "cp850"):
            assert E.undo(E.garble(t, w, r), s) in (t, None)
    twice = E.garble(E.garble("théâtre’s", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert "théâtre’s" in E.unchain(twice).values() and E.unchain("plain") == {}


def corpus(n=400):
    rnd = random.Random(1)
    say = lambda: " ".join(rnd.choice(rnd.choice([FR, DE, RU])) for _ in range(40))
    docs, bad = [], {}
    kinds = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman"), ("utf-8", "cp437")]
    for i in range(n):
        ws = [rnd.choice(FR if i % 2 else DE) for _ in range(40)]
        t = " ".join(ws)
        if i % 20 == 3:
            w, r = kinds[i // 20 % 4]
            bad[i] = t
            t = E.garble(t, w, r) if i % 40 == 3 else " ".join(ws[:20]) + " " + E.garble(" ".join(ws[20:]), w, r)
        docs.append((i, t, "s" if i % 3 else None))
    for i in range(n, n + 60):
        t = " ".join(rnd.choice(RU) for _ in range(30))
        if i % 15 == 0:
            bad[i] = t
            t = E.garble(t, "cp1251", "koi8_r")
        docs.append((i, t, "r"))
    del say
    return docs, bad


def test_found_and_restored(spark):
    docs, bad = corpus()
    docs += [(1000, None, "s"), (1001, "", "s"), (1002, "plain ascii " * 20_000, "s"), (1003, "lost � here", "s"), (None, "Ã©tÃ©", "s"), docs[3]]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, source string, chain string")
    got = {r["doc_id"] for r in E.find_garbled(df).collect()}
    assert got == set(bad) | {1003}
    back = {r["doc_id"]: r for r in E.restore_garbled(df.dropDuplicates(["doc_id"])).collect()}
    right = sum(back[i]["text"] == t for i, t in bad.items())
    assert right >= 0.9 * len(bad) and back[1003]["lost"] and not back[3]["lost"]
    assert E.find_garbled(df.limit(0)).count() == 0


def one_word_corpus(n=600):
    rnd = random.Random(5)
    plain = "the price of a room was about so we stayed and the view over the bay made it worth it".split()
    odd = [lambda: f"€{rnd.randint(10, 99)}", lambda: f"{rnd.randint(10, 44)}°C", lambda: rnd.choice(["year’s", "city’s", "owner’s", "it’s", "we’re"]), lambda: rnd.choice([*FR, "L’équipe", "l’été"])]
    docs, bad = [], {}
    for i in range(n):
        kind = i % 3
        words = [rnd.choice(plain) for _ in range(25)] + [f() for f in odd for _ in range(1 + 40 * (i % 50 == 7))]
        rnd.shuffle(words)
        t = " ".join(words)
        if i % 15 == 4:
            bad[i] = " ".join(w for w in words if w.isascii()) + " " + odd[kind]()
            t = E.garble(bad[i], "cp1252", "mac_roman" if i % 2 else "cp437")
        elif i % 50 == 7:
            two = f"{odd[2]()} {odd[i // 50 % 2]()}"
            bad[i] = f"{t} {two}"
            t += " " + E.garble(two, "cp1252", "mac_roman")
        docs.append((i, t, "s" if i % 2 else "t"))
    return docs, bad


def test_weak_evidence_is_pooled(spark):
    docs, bad = one_word_corpus()
    df = spark.createDataFrame(docs, "doc_id int, text string, source string")
    assert {r["doc_id"] for r in E.find_garbled(df).collect()} == set(bad)
    back = {r["doc_id"]: r["text"] for r in E.restore_garbled(df).collect()}
    assert back == bad
