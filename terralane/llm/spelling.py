"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles, and the form that each rare one stands for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free, lower_ascii, stored, tidy
from .shingles import mixed

#: Runs of letters up to U+00FF (fixed value of the contract); the shortest word that is compared.
LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST = 7
LEAST_N = 2
#: A word's form occurs at least so many times as often as the word.
TIMES = 10
#: One run in DAMAGED loses a letter, as its document and text decide.
DAMAGED = 31
#: Code points that two words with one key may differ in: a key's group is bounded by the alphabet, at most its square.
PART = 2
#: A word has so many parts at most, since each of its keys carries it: words of more than PART * PARTS letters have longer ones.
PARTS = 32
#: Rows of a block of a tile, and code points of one side of the tiles that are compared at once.
BLOCK = 256
TILE_CELLS = 4_000_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without its letter h % length where DAMAGED divides h, the crc32 of `<doc_id>:<run>`; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): runs of letters of the whole texts, A-Z lower-cased, some damaged, with at least SHORTEST code points and LEAST_N occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), lower_ascii(F.col("run"))).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word starts in it."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, words)])


def padded(codes: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of a row a word: its code points from the left, and from the right, with zeros behind them."""
    at = np.arange(width)
    inside = at < size[:, None]
    top = max(len(codes) - 1, 0)
    forth = np.where(inside, codes[np.minimum(start[:, None] + at, top)], 0)
    back = np.where(inside, codes[np.maximum((start + size)[:, None] - 1 - at, 0)], 0)
    return forth, back


def part_size(size):
    """Code points of the parts of words of `size` code points."""
    return np.maximum(PART, -(-size // PARTS))


def word_keys(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, part, long) of a word: as the longer or equal one of a pair, and as the one that lacks a letter.

    Positions of the longer word are cut into parts of part_size. Two words one edit apart agree on all before and behind
    the part with the edit, so they share that part's key: a hash of length, part, prefix and suffix.
    """
    c = mixed(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(BASE))
    n = len(c)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, BASE, U)]))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(c * power[:n], dtype=U)])  # of c[k] BASE^k
    keys, parts, longs = [], [], []
    for size, lacks in ((n, 0), (n + 1, 1)):
        step = int(part_size(size))
        start = np.arange(0, size, step)
        behind = np.minimum(start + step, size) - lacks  # where the suffix starts in this word
        prefix = sums[start]
        suffix = sums[n] - sums[behind]
        if lacks:  # as if the missing letter were there
            suffix = suffix * U(BASE)
        keys.append(mixed(mixed(prefix + U(size)) * U(3) + mixed(suffix + start.astype(U))))
        parts.append(start // step)
        longs.append(np.full(len(start), not lacks))
    return np.concatenate(keys).view(np.int64), np.concatenate(parts).astype(np.int32), np.concatenate(longs)


def keyed(words: DataFrame) -> DataFrame:
    """(key, part, long, word, n): a row for each key of each word."""

    def run(batches):
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            at = 0
            while at < len(words):  # bounded by letters: a long word has many keys
                end, letters = at, 0
                while end < len(words) and (end == at or letters < 200_000):
                    letters += len(words[end])
                    end += 1
                found = [word_keys(w) for w in words[at:end]]
                who = np.repeat(np.arange(at, end), [len(k) for k, _, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)] + [batch.column(0).take(pa.array(who)), pa.array(n[who])], ["key", "part", "long", "word", "n"]
                )
                at = end

    return words.select("word", "n").mapInArrow(tidy(run), "key long, part int, long boolean, word string, n long")


def tiles(first: np.ndarray, end: np.ndarray):
    """(rows, rows) of block pairs: each pair of rows of a group in exactly one of them; first and end are the groups' rows.

    Small groups of one size are taken together, larger ones are cut into blocks of BLOCK rows.
    """
    size = end - first
    for s in np.unique(size[size <= BLOCK]).tolist():
        if s < 2:
            continue
        left, right = np.triu_indices(s, 1)
        at = first[size == s]
        step = max(1, BLOCK * BLOCK // len(left))
        for k in range(0, len(at), step):
            yield (at[k : k + step, None] + left).ravel(), (at[k : k + step, None] + right).ravel()
    for a, b in zip(first[size > BLOCK].tolist(), end[size > BLOCK].tolist()):
        for x in range(a, b, BLOCK):
            rows = np.arange(x, min(x + BLOCK, b))
            for y in range(x, b, BLOCK):
                other = np.arange(y, min(y + BLOCK, b))
                left, right = np.repeat(rows, len(other)), np.tile(other, len(rows))
                keep = left < right
                yield left[keep], right[keep]


def near_in(codes: np.ndarray, start: np.ndarray, key: np.ndarray, part: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, sorted by key, that are one edit apart, each in the group of the part that holds the first difference."""
    size = np.diff(start)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(cut[1:], len(key))
    left, right = [], []
    for a, b in tiles(cut, end):
        ok = long[a] | long[b]  # two that lack a letter meet elsewhere
        longer = np.maximum(size[a], size[b])
        ok &= (longer - np.minimum(size[a], size[b]) <= 1) & (size[a] + ~long[a] == size[b] + ~long[b])
        a, b, longer = a[ok], b[ok], longer[ok]
        order = np.argsort(longer, kind="stable")
        a, b, longer = a[order], b[order], longer[order]
        at = 0
        while at < len(a):
            # as many pairs as the padded matrices of the widest of them allow
            step = max(1, TILE_CELLS // int(longer[at]))
            while step > 1 and step * int(longer[min(len(a), at + step) - 1]) > 2 * TILE_CELLS:
                step //= 2
            x, y, most = a[at : at + step], b[at : at + step], longer[at : at + step]
            at += step
            width = int(most.max())
            rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            forth, back = padded(codes, start[rows], size[rows], width)
            i, j = place[: len(x)], place[len(x) :]
            shorter = np.minimum(size[x], size[y])
            stop = np.ones((len(x), 1), bool)
            prefix = np.minimum(np.argmax(np.hstack([forth[i] != forth[j], stop]), axis=1), shorter)
            suffix = np.minimum(np.argmax(np.hstack([back[i] != back[j], stop]), axis=1), shorter)
            hit = (prefix + suffix >= most - 1) & (part[x] == part[y]) & (prefix // part_size(size[x] + ~long[x]) == part[x]) & ~((size[x] == size[y]) & (prefix == most))
            left.append(x[hit])
            right.append(y[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def near_links(rows: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of rows that stand sorted by key in their partitions.

    A row gives the number of a word's near words in one group and the one of largest n (ties: smallest) of them.
    """

    def compared(table: pa.Table):
        key = table.column(0).to_numpy()
        # a key that one row has links nothing
        same = key[1:] == key[:-1]
        many = np.flatnonzero(np.append(same, False) | np.append(False, same))
        table = table.take(pa.array(many))
        words = table.column(3).to_pylist()
        codes, start = code_points(words)
        a, b = near_in(codes, start, key[many], table.column(1).to_numpy(), table.column(2).to_numpy(zero_copy_only=False))
        here, there, n = np.concatenate([a, b]), np.concatenate([b, a]), table.column(4).to_numpy()
        rank = np.empty(len(words), int)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[there], -n[there], here))
        here, there = here[order], there[order]
        first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if len(here) else here
        counts = np.diff(np.append(first, len(here)))
        best = pa.array(there[first])
        out = pa.table([table.column(3).take(pa.array(here[first])), pa.array(counts), table.column(3).take(best), table.column(4).take(best)], ["word", "n_near", "near", "near_n"])
        yield from out.combine_chunks().to_batches()

    def run(batches):
        waiting = None  # the last key's rows: a batch may end within a group
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([waiting, table]) if waiting is not None else table
            key = table.column(0).to_numpy()
            done = int(np.searchsorted(key, key[-1], "left"))
            waiting = table.slice(done)
            if done:
                yield from compared(table.slice(0, done))
        if waiting is not None:
            yield from compared(waiting)

    return rows.mapInArrow(tidy(run), "word string, n_near long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last by pointer doubling; a form occurs TIMES as often, so chains are short."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        then = stored(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        free(now)
        now = then
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of largest n
    (ties: smallest in code-point order) if its n is at least TIMES the word's; root follows forms to the last. Rows with a null word
    are dropped; no rows give no rows. Words are dealt by the keys of their parts, so no step meets all words; of words of up to PART * PARTS
    letters a key's group is bounded by the alphabet, not by the data, and groups of longer ones by those that differ in one part alone.
    """
    words = stored(counts.where("word is not null").select("word", "n"), "words")
    rows = keyed(words)
    links = near_links(rows.repartition("key").sortWithinPartitions("key"))
    best = links.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    form = F.when(-F.col("best.minus") >= TIMES * F.col("n"), F.col("best.near"))
    base = stored(
        words.join(best, "word", "left").select(
            "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n")
        ),
        "variants",
    )
    last = roots(base.where("form is not null"))
    free(words)
    return base.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """variants() of the words of whole documents; a null text has none."""
    return variants(word_counts(docs, text))


#: tb: the crc32 of each byte, by its rule; bt: the bytes of `<doc_id>:<run>`; dl: words without one letter each.
ORACLE_SQL = """
WITH RECURSIVE tb AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
rn AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
bt AS (SELECT run, flatten(list_transform(string_split(d || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192::BIGINT + (unicode(x) >> 6), 128::BIGINT + (unicode(x) & 63)] END)) AS b FROM rn),
hs AS (SELECT run, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bt, tb),
dm AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hs),
wd AS (SELECT word, count(*) AS n FROM dm WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
dl AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM wd)),
lk AS (SELECT a.word, b.word AS near FROM dl a JOIN dl b ON a.i = b.i AND a.key = b.key AND a.word <> b.word UNION SELECT dl.word, wd.word FROM dl JOIN wd ON wd.word = dl.key UNION SELECT wd.word, dl.word FROM dl JOIN wd ON wd.word = dl.key),
bs AS (SELECT lk.word, count(*) AS n_near, arg_min(near, (-b.n, near)) AS best, max(b.n) AS best_n FROM lk JOIN wd b ON b.word = near GROUP BY 1),
fm AS (SELECT wd.word, wd.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * wd.n THEN best END AS form, CASE WHEN best_n >= 10 * wd.n THEN best_n END AS form_n FROM wd LEFT JOIN bs USING (word)),
ch AS (SELECT word, word AS root, 0 AS k FROM fm UNION ALL SELECT ch.word, fm.form, k + 1 FROM ch JOIN fm ON fm.word = ch.root WHERE fm.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM fm JOIN (SELECT word, arg_max(root, k) AS root FROM ch GROUP BY 1) USING (word)
"""
