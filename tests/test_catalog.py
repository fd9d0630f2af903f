import random

from plexora.plans import catalog


def test_every_supplier_is_a_seed(spark, tmp_path, rows):
    rnd = random.Random(3)
    pairs = [(rnd.randint(1, 60), rnd.randint(1, 40)) for _ in range(900)] + [(None, 1), (7, None), (99, 1)]
    spark.createDataFrame([(i,) for i in range(1, 61)], "s_suppkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(pairs, "l_suppkey int, l_partkey int").where("l_partkey IS NOT NULL").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = []
    for s in range(1, 61):
        near = sorted({b for a, b in pairs if a == s and b is not None})
        want += [(s, b, i + 1) for i, b in enumerate(near[:5])]
    assert rows(catalog.neighbor_cap_all(spark, str(tmp_path))) == sorted(want, key=repr)


def read_pair(text):
    """Latitude and longitude of a text, read character by character; None if it isn't usable."""
    t = "".join(" " if c in "()[],;°'\"" else c for c in text or "").upper()
    parts, hemi = t.replace("N", " N ").replace("S", " S ").replace("E", " E ").replace("W", " W ").split(), []
    try:
        if not set(parts) & set("NSEW"):
            lat, lon = map(float, parts)
        else:
            cur = []
            for x in parts:
                if x in "NSEW":
                    hemi.append(sum(float(v) / 60**i for i, v in enumerate(cur)) * (-1 if x in "SW" else 1))
                    cur = []
                else:
                    cur.append(x)
            lat, lon = hemi
    except ValueError:
        return None
    return (lat, lon) if abs(lat) <= 90 and abs(lon) <= 180 and (lat or lon) else None


def test_coordinates_of_every_notation(spark, tmp_path):
    texts = [
        "30.881223,-113.561315", "(31.1789658,-114.8076139)", "[16.05, 73.88]", "30.8779171, -113.5670430", "31.19254;-114.82883",
        " 31.182292 -114.820662 ", "31.182727N, 114.815176W", "16.471926S, 179.938492E", "31°11'29.2\"N 114°48'48.9\"W",
        "16°28'22.2\"S 179°55'41.5\"E", "0,0", "0.0, 0.0", "91.2044,-200.1133", "(,)", ",", "", "n/a", "unknown", None,
    ]
    spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)] * 2, "mbid string, coordinates string").write.parquet(f"{tmp_path}/mb_places.parquet")
    got = {r["id"]: (round(r["lat"], 9), round(r["lon"], 9)) for r in catalog.parsed_coordinates_all(spark, str(tmp_path)).collect()}
    want = {f"m{i}": tuple(round(x, 9) for x in p) for i, t in enumerate(texts) if (p := read_pair(t))}
    assert got == want and len(want) == 10
