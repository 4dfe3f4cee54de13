"""Corpus, tokenisation, packing and masking queries on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import corpus, documents, query, vocabulary, vocabulary_table
from queries.sql import PARTS, SEED, mix, seed, unit, with_parts
from textloom.operators import batching, examples, masking, packing
from textloom.operators.vocabulary import UNK, replacement_vocabulary
from textloom.operators.wordpiece import tokenise_text
from textloom.plans import pretraining
from textloom.session import write_through

CONFIG = examples.ExampleConfig(
    sentence_pair_prob=0.0, short_seq_prob=0.0, do_whole_word_mask=True, max_ngram_size=2, seed=SEED
)


def joined(xs, sep: str = ",") -> F.Column:
    return F.array_join((F.col(xs) if isinstance(xs, str) else xs).cast("array<string>"), sep)


@query(
    "corpus_lines",
    "WITH" + PARTS["lines"] + " SELECT shard, doc_id, line_no::BIGINT AS line_no, line FROM lines",
)
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped, non-empty lines with their order inside the document."""
    return corpus(spark, sf_dir).select(
        "shard", "doc_id", F.posexplode("lines").alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("vocabulary", with_parts("vocab", "SELECT token, id::BIGINT AS id FROM vocab"))
def vocabulary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary built from the corpus."""
    return vocabulary_table(spark, sf_dir).select("token", F.col("id").cast("bigint").alias("id"))


@query(
    "replacement_vocab",
    with_parts("vocab", "SELECT token FROM vocab WHERE NOT regexp_matches(token, '^\\[unused.*\\]$')"),
)
def replacement_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that may replace a masked one."""
    return replacement_vocabulary(vocabulary_table(spark, sf_dir))


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pretraining.tokenised_lines(corpus(spark, sf_dir), vocabulary(spark, sf_dir))


@query(
    "wordpiece_tokens",
    with_parts(
        "line_tokens",
        """SELECT source AS shard, d.doc_id, count(n) AS n_lines, coalesce(sum(n), 0)::BIGINT AS n_tokens,
                  coalesce(sum(len(list_filter(toks, lambda t: t = '[UNK]'))), 0)::BIGINT AS n_unknown,
                  md5(coalesce(array_to_string(flatten(list(toks ORDER BY line_no) FILTER (WHERE n IS NOT NULL)), ' '), ''))
                    AS tokens_md5
           FROM documents d LEFT JOIN numbered USING (doc_id) GROUP BY source, d.doc_id""",
    ),
)
def wordpiece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of whole documents, compared token by token through a digest."""
    vocab = vocabulary(spark, sf_dir)
    flat = tokens_of(spark, sf_dir).select("shard", "doc_id", F.size("lines").alias("n"), F.flatten("lines").alias("ids"))
    return flat.select(
        "shard",
        "doc_id",
        F.col("n").cast("bigint").alias("n_lines"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.size(F.filter("ids", lambda i: i == vocab.ids[UNK])).cast("bigint").alias("n_unknown"),
        F.md5(F.array_join(vocab.decode(F.col("ids")), " ")).alias("tokens_md5"),
    )


@query(
    "token_length_profile",
    with_parts(
        "line_tokens",
        """SELECT lang, count(*) AS n_docs, quantile_cont(n::DOUBLE, 0.5) AS median_tokens, max(n)::BIGINT AS max_tokens
           FROM (SELECT lang, doc_id, coalesce(sum(n), 0) AS n FROM documents LEFT JOIN numbered USING (doc_id)
                 GROUP BY lang, doc_id)
           GROUP BY lang""",
    ),
)
def token_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and maximum document length in tokens per data set (here: language).

    Lengths are counted per distinct value first, so the exact percentile keeps
    one entry per length, however many documents share it.
    """
    vocab = vocabulary(spark, sf_dir)
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    lens = docs.select("lang", F.size(tokenise_text(vocab, F.col("text"))).alias("n"))
    counted = lens.groupBy("lang", "n").agg(F.count("*").alias("m"))
    return counted.groupBy("lang").agg(
        F.sum("m").alias("n_docs"),
        F.percentile("n", 0.5, F.col("m")).alias("median_tokens"),
        F.max("n").cast("bigint").alias("max_tokens"),
    )


def _groups(spark: SparkSession, sf_dir: str, config=CONFIG) -> DataFrame:
    return pretraining.packed_groups(write_through(pretraining.with_lengths(tokens_of(spark, sf_dir))), config)


@query(
    "pack_sequences",
    with_parts(
        "packed",
        """SELECT p.shard, p.grp, count(*) AS n_lines, sum(l.n)::BIGINT AS n_tokens, min(l.doc_id) AS first_doc,
                  max(l.doc_id) AS last_doc
           FROM packed p JOIN numbered l USING (shard, rn) GROUP BY p.shard, p.grp""",
    ),
)
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into groups of at least 512 tokens, per source."""
    tokens = tokens_of(spark, sf_dir).select("shard", "doc_id", F.transform("lines", F.size).alias("lens"))
    tokens = write_through(tokens)
    runs = packing.pack_lines(tokens, CONFIG.max_seq_length).join(tokens, ["shard", "doc_id"])
    rows = runs.select("shard", "doc_id", "lens", F.explode("runs").alias("r"))
    taken = F.slice("lens", F.col("r.first") + 1, F.col("r.size"))
    return (
        rows.select("shard", "doc_id", "r.*", F.aggregate(taken, F.lit(0), lambda a, x: a + x).alias("n"))
        .groupBy("shard", "grp")
        .agg(
            F.sum("size").cast("bigint").alias("n_lines"),
            F.sum("n").cast("bigint").alias("n_tokens"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
        )
    )


@query(
    "chunk_long_sequences",
    with_parts(
        "chunks",
        """SELECT shard, grp, chunk::BIGINT AS chunk, len(toks)::BIGINT AS n_tokens,
                  md5(array_to_string(toks, ' ')) AS tokens_md5 FROM chunks""",
    ),
)
def chunk_long_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups far above the maximum are cut into chunks, others trimmed."""
    vocab = vocabulary(spark, sf_dir)
    groups = _groups(spark, sf_dir)
    chunks = examples.chunk_segments(examples.split_segments(groups, CONFIG), CONFIG)
    return chunks.select(
        "shard",
        "grp",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.size("first").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(vocab.decode(F.col("first")), " ")).alias("tokens_md5"),
    )


def _with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = examples.chunk_segments(examples.split_segments(_groups(spark, sf_dir), CONFIG), CONFIG)
    vocab = vocabulary(spark, sf_dir)
    return examples.find_words(examples.frame_segments(chunks, vocab), vocab, CONFIG)


def _span_text(xs) -> F.Column:
    return F.array_join(F.transform(xs, lambda s: F.concat_ws("-", s["b"], s["e"])), ",")


@query(
    "word_grams",
    with_parts(
        "spans",
        """SELECT shard, grp, chunk::BIGINT AS chunk, count(b) AS n_words,
                  md5(coalesce(string_agg(b || '-' || e, ',' ORDER BY b), '')) AS spans_md5
           FROM framed LEFT JOIN spans USING (shard, grp, chunk) WHERE dupe = 0 GROUP BY shard, grp, chunk""",
    ),
)
def word_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every framed example as token spans."""
    return (
        _with_words(spark, sf_dir)
        .select(
            "shard",
            "grp",
            F.col("chunk").cast("bigint").alias("chunk"),
            F.size("words").cast("bigint").alias("n_words"),
            F.md5(_span_text(F.col("words"))).alias("spans_md5"),
        )
    )


@query(
    "ngram_candidates",
    with_parts(
        "ngrams",
        """SELECT shard, grp, chunk::BIGINT AS chunk, count(b) AS n_spans,
                  md5(coalesce(string_agg(b || '-' || e, ',' ORDER BY n, b), '')) AS spans_md5
           FROM framed LEFT JOIN ngrams USING (shard, grp, chunk) WHERE dupe = 0 GROUP BY shard, grp, chunk""",
    ),
)
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of one or two touching words of every example."""
    grams = masking.ngram_spans(F.col("words"), CONFIG.max_ngram_size)
    return (
        _with_words(spark, sf_dir)
        .select("shard", "grp", F.col("chunk").cast("bigint").alias("chunk"), grams.alias("grams"))
        .select(
            "shard",
            "grp",
            "chunk",
            F.size("grams").cast("bigint").alias("n_spans"),
            F.md5(_span_text(F.col("grams"))).alias("spans_md5"),
        )
    )


def masked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.masked_examples(_groups(spark, sf_dir), vocabulary(spark, sf_dir), CONFIG)


@query(
    "mask_selection",
    with_parts(
        "chosen",
        """SELECT ex, count(b) AS n_spans, coalesce(sum(e - b), 0)::BIGINT AS n_masked,
                  coalesce(string_agg(b || '-' || e, ',' ORDER BY b), '') AS spans
           FROM (SELECT shard || '|' || dupe || '|' || grp || '|' || chunk AS ex FROM framed) LEFT JOIN chosen USING (ex)
           GROUP BY ex""",
    ),
)
def mask_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word n-grams chosen for masking in every example."""
    return (
        masked_examples(spark, sf_dir)
        .select(
            F.concat_ws("|", *examples.EXAMPLE_KEYS).alias("ex"),
            F.size("spans").cast("bigint").alias("n_spans"),
            F.aggregate("spans", F.lit(0), lambda a, s: a + s["e"] - s["b"]).cast("bigint").alias("n_masked"),
            _span_text(F.col("spans")).alias("spans"),
        )
    )


@query(
    "mask_corruption",
    with_parts(
        "masked",
        """SELECT ex, coalesce(string_agg(pos, ',' ORDER BY pos), '') AS positions,
                  md5(coalesce(string_agg(label, ' ' ORDER BY pos), '')) AS labels_md5,
                  md5(coalesce(string_agg(new_tok, ' ' ORDER BY pos), '')) AS new_md5
           FROM (SELECT shard || '|' || dupe || '|' || grp || '|' || chunk AS ex FROM framed) LEFT JOIN masked USING (ex)
           GROUP BY ex""",
    ),
)
def mask_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked positions with their original and their new tokens."""
    vocab = vocabulary(spark, sf_dir)
    return (
        masked_examples(spark, sf_dir)
        .select(
            F.concat_ws("|", *examples.EXAMPLE_KEYS).alias("ex"),
            joined("masked.pos").alias("positions"),
            F.md5(F.array_join(vocab.decode(F.col("masked.label")), " ")).alias("labels_md5"),
            F.md5(F.array_join(vocab.decode(F.col("masked.new")), " ")).alias("new_md5"),
        )
    )


PRETRAINING_SQL = with_parts(
    "masked",
    """, masks AS (
     SELECT ex, list(pos ORDER BY pos) AS pos, list(v.id ORDER BY pos) AS labels,
            map_from_entries(list({'k': pos, 'v': new_tok})) AS new_toks
     FROM masked m JOIN vocab v ON v.token = m.label GROUP BY ex),
   filled AS (
     SELECT f.shard || '|' || f.dupe || '|' || f.grp || '|' || f.chunk AS ex, unnest(f.toks) AS tok,
            unnest(range(len(f.toks))) AS p, f.grp FROM framed f),
   replaced AS (
     SELECT f.ex, f.p, coalesce(m.new_tok, f.tok) AS tok FROM filled f LEFT JOIN masked m ON m.ex = f.ex AND m.pos = f.p),
   inputs AS (
     SELECT r.ex, list(v.id ORDER BY r.p) AS ids FROM replaced r JOIN vocab v ON v.token = r.tok GROUP BY r.ex)
   SELECT i.ex, md5(array_to_string(i.ids || list_transform(range(512 - len(i.ids)), lambda x: 0), ',')) AS input_md5,
          array_to_string(coalesce(m.pos, []) || list_transform(range(76 - len(coalesce(m.pos, []))), lambda x: 0), ',')
            AS positions,
          array_to_string(coalesce(m.labels, []) || list_transform(range(76 - len(coalesce(m.labels, []))), lambda x: 0), ',')
            AS label_ids,
          coalesce(len(m.pos), 0)::BIGINT AS n_weights
   FROM inputs i LEFT JOIN masks m USING (ex)""",
)


@query("pretraining_examples", PRETRAINING_SQL)
def pretraining_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: corpus to padded, masked, fixed-length examples, twice over."""
    rows = pretraining.pretraining_examples(corpus(spark, sf_dir), vocabulary(spark, sf_dir), CONFIG)
    return rows.select(
        F.concat_ws("|", *examples.EXAMPLE_KEYS).alias("ex"),
        F.md5(joined("input_ids")).alias("input_md5"),
        joined("masked_lm_positions").alias("positions"),
        joined("masked_lm_ids").alias("label_ids"),
        F.aggregate("masked_lm_weights", F.lit(0.0).cast("double"), lambda a, x: a + x)
        .cast("bigint")
        .alias("n_weights"),
    )


SHORT_CONFIG = examples.ExampleConfig(
    max_seq_length=256, sentence_pair_prob=0.0, short_seq_prob=0.3, dupe_factor=2, seed=SEED
)
_LINE_KEYS = ["shard", "dupe", "doc_id", "line_no"]
SHORT_SQL = with_parts(
    "line_tokens",
    f""", targets AS (
      SELECT shard, dupe, doc_id, line_no, rn, n,
             CASE WHEN rn > 1 AND {unit(seed(str(SEED), "'short'", *_LINE_KEYS))} < 0.3
                  THEN 5 + {seed(str(SEED), "'short-length'", *_LINE_KEYS)} % 252 ELSE 256 END AS target
      FROM numbered, (SELECT unnest([0, 1]) AS dupe)),
    short_packed AS (
      SELECT shard, dupe, rn, 0::BIGINT AS grp, n AS acc, target FROM targets WHERE rn = 1
      UNION ALL
      SELECT t.shard, t.dupe, t.rn, CASE WHEN p.acc >= p.target THEN p.grp + 1 ELSE p.grp END,
             CASE WHEN p.acc >= p.target THEN t.n ELSE p.acc + t.n END,
             CASE WHEN p.acc >= p.target THEN t.target ELSE p.target END
      FROM short_packed p JOIN targets t ON t.shard = p.shard AND t.dupe = p.dupe AND t.rn = p.rn + 1)
    SELECT shard, dupe::BIGINT AS dupe, grp, count(*) AS n_lines, max(acc)::BIGINT AS n_tokens,
           max(target)::BIGINT AS target
    FROM short_packed GROUP BY shard, dupe, grp""",
)


@query("pack_short_targets", SHORT_SQL)
def pack_short_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing where three groups in ten get a target drawn below the maximum."""
    groups = _groups(spark, sf_dir, SHORT_CONFIG)
    return groups.select(
        "shard",
        F.col("dupe").cast("bigint").alias("dupe"),
        "grp",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.flatten("lines")).cast("bigint").alias("n_tokens"),
        F.col("target").cast("bigint").alias("target"),
    )


PAIR_CONFIG = examples.ExampleConfig(
    max_seq_length=512, sentence_pair_prob=0.5, short_seq_prob=0.0, dupe_factor=1, seed=SEED
)
_GROUP_KEYS = [str(SEED), "'pair'", "shard", "0", "grp"]
_COIN_KEYS = [str(SEED), "'coin'", "shard", "0", "grp"]
PAIR_SQL = with_parts(
    "packed",
    f""", members AS (
      SELECT p.shard, p.grp, l.toks, l.n,
             row_number() OVER (PARTITION BY p.shard, p.grp ORDER BY p.rn) - 1 AS i,
             CASE WHEN {unit(seed(*_GROUP_KEYS))} < 0.5 THEN 254 ELSE 100000 END AS goal,
             {seed(*_COIN_KEYS)} AS coin_seed
      FROM packed p JOIN numbered l USING (shard, rn)),
    coins AS (SELECT *, {unit(mix("coin_seed", "i"))} AS coin FROM members),
    placed AS (
      SELECT shard, grp, i, TRUE AS is_first, n AS a, 0::BIGINT AS b FROM coins WHERE i = 0
      UNION ALL
      SELECT shard, grp, i, ok, CASE WHEN ok THEN a + n ELSE a END, CASE WHEN ok THEN b ELSE b + n END
      FROM (SELECT c.shard, c.grp, c.i, c.n, p.a, p.b,
                   p.a = 0 OR p.a + c.n < c.goal OR (p.b = 0 AND p.a < c.goal AND c.coin < 0.5) AS ok
            FROM placed p JOIN coins c ON c.shard = p.shard AND c.grp = p.grp AND c.i = p.i + 1)),
    split AS (
      SELECT shard, grp,
             coalesce(flatten(list(toks ORDER BY i) FILTER (WHERE is_first)), []) AS first,
             coalesce(flatten(list(toks ORDER BY i) FILTER (WHERE NOT is_first)), []) AS second
      FROM placed JOIN coins USING (shard, grp, i) GROUP BY shard, grp)
    SELECT shard, grp, len(first)::BIGINT AS n_first, len(second)::BIGINT AS n_second,
           md5(array_to_string(first, ' ')) AS first_md5,
           CASE WHEN len(second) = 0 THEN md5('') ELSE md5(array_to_string(second, ' ')) END AS second_md5
    FROM split""",
)


@query("segment_pairs", PAIR_SQL)
def segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a group split over two segments in half of the groups."""
    vocab = vocabulary(spark, sf_dir)
    split = examples.split_segments(_groups(spark, sf_dir, PAIR_CONFIG), PAIR_CONFIG)
    text = lambda c: F.md5(F.array_join(vocab.decode(F.col(c)), " "))
    return split.select(
        "shard",
        "grp",
        F.size("first").cast("bigint").alias("n_first"),
        F.size("second").cast("bigint").alias("n_second"),
        text("first").alias("first_md5"),
        text("second").alias("second_md5"),
    )


@query(
    "shuffle_batches",
    f"""WITH ranked AS (
          SELECT doc_id, row_number() OVER (ORDER BY {seed(str(SEED), "'shuffle'", "1", "doc_id")}, doc_id) - 1 AS r
          FROM documents)
        SELECT doc_id, r // 32 AS batch, r % 32 AS slot FROM ranked WHERE r // 32 < (SELECT count(*) // 32 FROM documents)""",
)
def shuffle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global shuffle of an epoch, cut into batches of 32 without the remainder."""
    docs = documents(spark, sf_dir, "doc_id")
    rows = batching.shuffled_batches(docs, F.col("doc_id"), 32, epoch=1, seed=SEED)
    return rows.select("doc_id", F.col("batch").cast("bigint").alias("batch"), F.col("slot").cast("bigint").alias("slot"))


@query(
    "collate_batches",
    f"""WITH ranked AS (
          SELECT doc_id, len(text) AS n,
                 row_number() OVER (ORDER BY {seed(str(SEED), "'shuffle'", "2", "doc_id")}, doc_id) - 1 AS r
          FROM documents)
        SELECT r // 16 AS batch, string_agg(doc_id, ',' ORDER BY r) AS doc_ids, string_agg(n, ',' ORDER BY r) AS lengths
        FROM ranked GROUP BY r // 16 HAVING count(*) = 16""",
)
def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per batch of 16, columns as arrays in slot order."""
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.length("text").alias("n"))
    rows = batching.shuffled_batches(docs, F.col("doc_id"), 16, epoch=2, seed=SEED)
    out = batching.collate(rows, {"doc_id": "bigint", "n": "bigint"})
    return out.select(
        F.col("batch").cast("bigint").alias("batch"), joined("doc_id").alias("doc_ids"), joined("n").alias("lengths")
    )


@query(
    "pad_batches",
    """WITH padded AS (
         SELECT doc_id, lang, FALSE AS is_pad FROM documents
         UNION ALL
         SELECT doc_id, lang, TRUE FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 1),
                (SELECT unnest(range(40 - count(*) % 40)) AS k FROM documents))
       SELECT doc_id, lang, is_pad, count(*) AS n FROM padded GROUP BY ALL""",
)
def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set extended to a multiple of batch size times devices (8 x 5)."""
    padded = batching.pad_for_devices(documents(spark, sf_dir, "doc_id", "lang"), "doc_id", 8, 5)
    return padded.groupBy("doc_id", "lang", "is_pad").agg(F.count("*").alias("n"))
