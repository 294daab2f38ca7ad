"""Spelling variants by a symmetric-delete join.

Words are counted in Spark (combined before the shuffle) and stored with a
number.  Every word emits the hash of itself and of each of its distinct single
deletions; a deletion's row also says which places give it (a run of equal
characters).  Rows meet on the hash.  Two words are near if one is a deletion
of the other or if both lose the same place, so the places settle nearly all
candidates in the join; the words themselves are then fetched and their
distance must be exactly one.  A near pair shares exactly one distinct key, so
it comes once.  A key's rows are words that add one character to it: at most
(length + 1) x 90 + 1 of them, whatever the corpus.

Hashes are polynomials from prefix sums, so a word of L characters costs L
small rows, not L copies.  Equal hashes of different strings only make
candidates that fail.

A word's form is its most frequent near word, if at least ten times as
frequent; roots follow forms by pointer doubling (a count grows tenfold each
step, so five rounds reach any end), each round a stored table.

Defined results: a null text has no words, a null doc_id is an empty one in the
hash; equal counts go to the smallest word; repeated rows count again; an empty
table gives an empty result; runs of any length are words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.arrowtext import slices, small_batches
from kindred.llm.conversation_trie import CRC32
from kindred.storage import discard, materialise

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 7
LEAST_COUNT = 2
TIMES = 10
DROP_EVERY = 31
KEYS = "key long, id long, lo int, hi int"
ROWS = 1 << 16

# Two primes below 2^31 and bases for the hashes.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)


def word_counts(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters after the contract's thinning, the frequent and long enough ones."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    low = runs.select("d", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("low"))
    hashed = low.select("low", F.crc32(F.concat_ws(":", "d", "low")).alias("h"))
    at = (F.col("h") % F.char_length("low")).cast("int")
    shorter = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.char_length("low")))
    words = hashed.select(F.when(F.col("h") % DROP_EVERY == 0, shorter).otherwise(F.col("low")).alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    p = np.uint64(prime)
    while len(out) < n:
        out = np.concatenate((out, out * (out[-1] * np.uint64(base) % p) % p))
    return out[:n]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's own hash (places -1) and those of its distinct deletions."""
    for whole in batches:
        for batch in slices(whole, "word"):
            words = batch.column("word").to_pylist()
            size = np.array([len(w) for w in words], np.int64)
            start = np.concatenate(([0], np.cumsum(size)))
            chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            owner = np.repeat(np.arange(len(words)), size)
            place = np.arange(len(chars)) - start[owner]
            fresh = (place == 0) | (chars != np.concatenate(([0], chars[:-1])))
            first = np.flatnonzero(fresh)
            last = np.concatenate((first[1:], [len(chars)])) - 1
            own = key = np.zeros(1, np.uint64)
            for base, prime in zip(BASES, PRIMES, strict=True):
                p = np.uint64(prime)
                each = (chars.astype(np.uint64) + np.uint64(1)) * _powers(base, prime, int(size.max(initial=1)))[place] % p
                run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
                total = run[start[1:]] - run[start[:-1]]
                head = run[first] - run[start[:-1]][owner[first]]
                tail = (total[owner[first]] - head - each[first]) % p * np.uint64(pow(base, -1, prime)) % p
                key = (key << np.uint64(32)) ^ ((head + tail) % p)
                own = (own << np.uint64(32)) ^ (total % p)
            ids = batch.column("id").to_numpy()
            keys = np.concatenate((own, key)).view(np.int64)
            found = {"key": keys, "id": np.concatenate((ids, ids[owner[first]])), "lo": np.concatenate((np.full(len(words), -1), place[first])).astype(np.int32), "hi": np.concatenate((np.full(len(words), -1), place[last])).astype(np.int32)}
            for at in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_pydict({c: pa.array(v[at : at + ROWS]) for c, v in found.items()})


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of words (id, word, n) at distance exactly one, each pair once."""
    keys = words.select("id", "word").mapInArrow(_emit, KEYS)
    a, b = keys.alias("a"), keys.alias("b")
    kept, other = F.col("a.lo") < 0, F.col("b.lo") < 0
    same = ~kept & ~other & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & ((kept != other) | same)).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))
    left = words.select(F.col("id").alias("i"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = words.select(F.col("id").alias("j"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    return met.join(left, "i").join(right, "j").where(F.levenshtein("a", "b", 1) == 1)


def spelling_forms(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form and form_n of stored words (id, word, n)."""
    side = lambda k, o: F.struct(F.col(k).alias("word"), (-F.col(f"n_{o}")).alias("less"), F.col(o).alias("near"))
    sides = near_pairs(words).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    form_n = -F.col("best.less")
    enough = form_n >= times * F.col("n")
    return words.select("word", "n").join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, form_n).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form: pointers double until none moves."""
    up = materialise(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(up.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(up)
        up = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return up


def spelling_variants(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents."""
    counted = word_counts(docs, least_chars=least_chars, least_count=least_count)
    words = materialise(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    forms = materialise(spelling_forms(words, times=times), "forms")
    discard(words)
    found = forms.join(roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over the whole documents table."""
    small_batches(spark, rows=20_000)
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_BYTES = "list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::UBIGINT)"
OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), '{UPPER}', '{LOWER}') AS low FROM documents
), counted AS (
  SELECT low, hex(encode(d || ':' || low)) AS x, count(*) AS c FROM runs GROUP BY ALL
), hashed AS (
  SELECT low, c, {CRC32.format(_BYTES)} AS h FROM counted
), thinned AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(low, 1, (h % length(low))::BIGINT) || substr(low, (h % length(low) + 2)::BIGINT) ELSE low END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), cut AS (
  SELECT word, n, place, substr(word, 1, place) || substr(word, place + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(x.other) AS form, min(x.other_n) AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN near x ON x.word = w.word AND x.other_n = b.top AND b.top >= 10 * w.n GROUP BY ALL
), climb AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM climb c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN climb c ON c.word = f.word AND c.next IS NULL
"""
