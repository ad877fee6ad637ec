"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens and its leading tokens, in which a token
with a digit is a variable field. Below a path, a token is fixed at its place if enough
texts have it there, and every other token is a variable field too. What is left is the
line's template. A template whose lines recur in `TEXTS` different texts, and that is fixed
in most of its tokens, is dropped from every document. The number is the same for a table
of any size.

A path, a token, a template, a line or a text that a great part of all rows share is a hot
key of the joins. At most `HOT` keys can hold more than that part of the rows; these are
broadcast, their rows are dealt out by salts, and what they join is repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import settle

TEXTS = 10
LEADING = 4
FIXED = 0.6
FIELD = "<*>"
HOT = 500
SALTS = 64
BUCKETS = 1 << 18
# A token with a digit, found from its start in one go; the twin's engine knows neither lookbehind nor possession.
WITH_DIGIT = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
WITH_DIGIT_SQL = "[^ ]*[0-9][^ ]*"


def token_count(line: Column) -> Column:
    """One more than the line's spaces."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def masked(text: Column) -> Column:
    """The text with a variable field for each token that holds a digit."""
    return F.regexp_replace(text, WITH_DIGIT, FIELD)


def _lines(docs: DataFrame, text_col: str, leading: int) -> DataFrame:
    """(key, at, line, n, lead) of every line that is not blank; the key is its text's md5."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.md5(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line")).select("key", "at", F.trim("line").alias("line")).where("line <> ''")
    return rows.withColumn("n", token_count(F.col("line"))).withColumn("lead", masked(F.substring_index("line", " ", leading)))


def _spread(rows: DataFrame, few: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined with `few`, one row a key, where `counts` (keys, rows) tells about how many rows a key has.

    Rows of hot keys, and those whose first key is null, are dealt out by salts.
    """
    total = counts.agg(F.sum("rows").alias("rows")).first()["rows"] or 0
    often = F.broadcast(counts.where(F.col("rows") > max(1.0, total / HOT)).select(*keys, F.lit(True).alias("__hot")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    dealt = rows.join(often, keys, "left").withColumn("__salt", F.when(F.coalesce("__hot", F.col(keys[0]).isNull()), salt).otherwise(0)).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = few.join(often, keys, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    # by a merge at every size, so that a small table is no other case than a large one
    return dealt.join(repeated.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def _at_least(need: int, forms: DataFrame, several: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows) of the groups `by` that hold forms of `need` different texts; `rows` counts the forms.

    `forms` has each form's number of texts, `several` a row (with its text's key) for each
    form of a text that has more than one on its path. What such a text has too many in a
    group is taken off the group's sum.
    """
    sums = forms.groupBy(*by).agg(F.sum("texts").alias("texts"), F.count("*").alias("rows")).where(F.col("texts") >= need)
    over = several.groupBy(*by, "key").agg((F.count("*") - 1).alias("over")).where("over > 0").groupBy(*by).agg(F.sum("over").alias("over"))
    return sums.join(over, by, "left").where(F.col("texts") - F.coalesce("over", F.lit(0)) >= need).select(*by, "rows")


def dropped_lines(docs: DataFrame, text_col: str = "text", texts: int = TEXTS, leading: int = LEADING, fixed: float = FIXED) -> DataFrame:
    """(key, places): the numbers of the lines to drop from the texts of that md5."""
    path, form = ["n", "lead"], ["n", "lead", "line"]
    lines = _lines(docs, text_col, leading)
    paths = lines.select(*path, "key").distinct().groupBy(*path).agg(F.count("*").alias("rows"))
    paths = settle(paths.where(F.col("rows") >= texts), "paths")
    # buckets of the recurring paths, a set number at most, keep most other lines out of the join
    bucket = F.pmod(F.xxhash64(*path), F.lit(BUCKETS)).alias("bucket")
    near = lines.select("*", bucket).join(F.broadcast(paths.select(bucket).distinct()), "bucket", "leftsemi")
    # the lines of copies count once
    near = near.select("key", "at", *path, masked(F.col("line")).alias("line")).distinct()
    held = settle(_spread(near, paths.select(*path), path, paths), "lines")
    forms = settle(held.select(*form, "key").distinct().groupBy(*form).agg(F.count("*").alias("texts")), "forms")
    # the leading tokens are fixed, as their path recurs; only those behind them are counted
    behind = F.slice(F.split("line", " "), leading + 1, F.greatest(F.col("n") - leading, F.lit(1)))
    tokens = settle(forms.select(*form, "texts", F.posexplode(behind).alias("place", "token")), "tokens")
    # a text counts once for a token or template; the sum over forms counts a text with several once for each
    many = held.groupBy(*path, "key").agg(F.min("line").alias("first"), F.max("line").alias("last")).where("first < last").select(*path, "key")
    several = settle(held.join(many, [*path, "key"], "leftsemi").select(*form, "key").distinct(), "several")
    spot = [*path, "place", "token"]
    common = settle(_at_least(texts, tokens, several.select(*path, "key", F.posexplode(behind).alias("place", "token")), spot), "common")
    marked = _spread(tokens, common.select(*spot, F.lit(True).alias("fixed")), spot, common, "left")
    word = F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD))
    in_order = F.array_sort(F.collect_list(F.struct("place", word.alias("word"))))
    rest = marked.groupBy(*form).agg(in_order.alias("rest"))
    words = F.concat(F.split("lead", " "), F.coalesce(F.col("rest.word"), F.array()))
    shapes = forms.join(rest, form, "left").withColumn("words", words)
    shapes = shapes.select(*form, "texts", F.concat_ws(" ", "words").alias("template"), F.size(F.filter("words", lambda w: w != FIELD)).alias("kept"))
    shape = [*path, "template"]
    firm = settle(shapes.where(F.col("kept") >= fixed * F.col("n")), "shapes")
    recurring = settle(_at_least(texts, firm, several.join(firm.select(*form, "template"), form), shape), "recurring")
    gone = settle(_spread(firm, recurring.select(*shape), shape, recurring).select(*form, F.col("texts").alias("rows")), "gone")
    found = _spread(held, gone.select(*form), form, gone)
    return found.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("places"))


def drop_templates(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """`docs` without the lines of recurring templates; other columns and all rows stay.

    Tokens stand between single spaces, after spaces around the line are cut off. Blank
    lines are no templates and stay. Exact copies count as one text, so copies alone make
    no line recur. Null texts stay null, and a text may become empty. Equal rows are treated
    alike. Columns of any other name are untouched.
    """
    text = F.col(text_col).cast("string")
    copies = settle(docs.select(F.md5(text).alias("__key")).where("__key is not null").groupBy("__key").agg(F.count("*").alias("rows")).where("rows > 1"), "copies")
    gone = settle(dropped_lines(docs, text_col, **settings).select(F.col("key").alias("__key"), F.col("places").alias("__places")), "places")
    joined = _spread(docs.withColumn("__key", F.md5(text)), gone, ["__key"], copies, "left")
    left = F.filter(F.split(text, "\n"), lambda line, at: ~F.array_contains("__places", at))
    new = F.when(F.col("__places").isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, n_lines, n_kept, kept_sha256) of every row: lines before and after, and what is left.

    A null text has no lines, and the digest of nothing.
    """
    before = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n")), F.lit(0)).alias("n_lines"))
    before = before.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    after = drop_templates(before, "text", **settings)
    kept = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return after.select(F.col("id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(kept).cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def report_sql(texts: int = TEXTS, leading: int = LEADING, fixed: float = FIXED) -> str:
    """The same report in SQL over `documents` (doc_id, text)."""
    lead = f"array_to_string(list_slice(string_split(line, ' '), 1, {leading}), ' ')"
    return f"""
    WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
    split AS (SELECT text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM texts),
    lines AS (
      SELECT text, line_no, len(string_split(line, ' ')) AS n, regexp_replace({lead}, '{WITH_DIGIT_SQL}', '{FIELD}', 'g') AS lead, regexp_replace(line, '{WITH_DIGIT_SQL}', '{FIELD}', 'g') AS line
      FROM split WHERE line <> ''),
    often AS (SELECT n, lead FROM lines GROUP BY n, lead HAVING count(DISTINCT text) >= {texts}),
    held AS (SELECT lines.* FROM lines JOIN often USING (n, lead)),
    forms AS (SELECT DISTINCT n, lead, line FROM held),
    tokens AS (SELECT *, generate_subscripts(string_split(line, ' '), 1) AS place, unnest(string_split(line, ' ')) AS token FROM forms),
    common AS (SELECT t.n, t.lead, t.place, t.token FROM tokens t JOIN held h USING (n, lead, line) GROUP BY t.n, t.lead, t.place, t.token HAVING count(DISTINCT h.text) >= {texts}),
    words AS (SELECT t.*, CASE WHEN c.token IS NULL THEN '{FIELD}' ELSE t.token END AS word FROM tokens t LEFT JOIN common c USING (n, lead, place, token)),
    shapes AS (SELECT n, lead, line, string_agg(word, ' ' ORDER BY place) AS template, count(*) FILTER (word <> '{FIELD}') AS kept FROM words GROUP BY n, lead, line),
    recurring AS (SELECT s.n, s.lead, s.template FROM shapes s JOIN held h USING (n, lead, line) WHERE s.kept >= {fixed} * s.n GROUP BY s.n, s.lead, s.template HAVING count(DISTINCT h.text) >= {texts}),
    gone AS (SELECT DISTINCT h.text, h.line_no FROM held h JOIN shapes s USING (n, lead, line) JOIN recurring r USING (n, lead, template) WHERE s.kept >= {fixed} * s.n),
    pieces AS (SELECT text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS piece FROM texts),
    kept AS (
      SELECT p.text, coalesce(string_agg(p.piece, chr(10) ORDER BY p.line_no) FILTER (g.line_no IS NULL), '') AS rest
      FROM pieces p LEFT JOIN gone g ON p.text = g.text AND p.line_no = g.line_no GROUP BY p.text)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
      CASE WHEN coalesce(k.rest, '') = '' THEN 0 ELSE len(string_split(k.rest, chr(10))) END::BIGINT AS n_kept,
      sha256(coalesce(k.rest, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept k ON d.text = k.text
    """
