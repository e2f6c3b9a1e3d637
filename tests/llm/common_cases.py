"""Small tables that every operator on documents must take, and helpers to compare results."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega sun moon river stone tree cloud wind fire water earth light dark road hill sea".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts with exact and near copies, nulls, empty texts, a long text, ties and repeated rows."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts[3] = texts[2]
    words = texts[5].split()
    texts[4] = " ".join([*words[:10], "changed", *words[11:]])
    texts[6], texts[7], texts[8] = None, "", " \n\t "
    texts[9] = sentence(rng, 6000)
    texts[10] = "one two"
    shared = sentence(rng, 60)
    for k in (11, 12, 13):
        texts[k] = f"{sentence(rng, 20)} {shared} {sentence(rng, 20)}"
    texts[14] = "line again\nline again\n\nother\nline again " + "a b c d e f " * 4
    texts[15] = "Ünïcödé 漢字 text ☃ with İ and ß " * 3
    rows = [(i, t, "en", random.Random(i).choice(["x", "y", "z", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    return rows


def table(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(docs):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["hash", "spans", "fp", "size", "w", "row", "rank", "length", "component", "node", "label", "_key", "gram", "target", "h", "n", "d"]
    return docs.select("*", *[F.lit(7).alias(n) for n in names])


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def components_of(nodes, linked) -> dict:
    """Smallest reachable node of each, by brute force."""
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    nodes = list(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
