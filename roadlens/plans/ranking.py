"""Queries of sorting and top-k, and of plate texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import plates as op
from ..operators.aggregates import letter_votes
from ..operators.windows import spread
from ..sources import adapters as src
from .aggregates import LEAST, SKIP, VOTES
from .base import query
from .joins import FRAME

C = F.col


@query("t1_rank_classes", "SELECT id, class, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rank FROM scr WHERE score >= 0", "scr")
def t1(spark, d):
    w = Window.partitionBy("id").orderBy(C("score").desc(), "class")
    return src.scores(spark, d).where("score >= 0").select("id", "class", "score", F.row_number().over(w).cast("long").alias("rank"))


@query("t2_best_class", "SELECT id, max_by(class, score * 100 - class) AS class FROM scr GROUP BY 1", "scr")
def t2(spark, d):
    return src.scores(spark, d).groupBy("id").agg(F.max_by("class", F.struct("score", -C("class"))).alias("class"))


PAIRED = """fs AS (SELECT label AS class, q AS w FROM smp QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1),
  ps AS (SELECT smp.id, a.class AS c1, b.class AS c2, CAST(list_sum(list_transform(range(1, len(smp.q) + 1), lambda i: smp.q[i] * (a.w[i] - b.w[i]))) AS BIGINT) AS s FROM smp, fs a, fs b WHERE b.class - a.class IN (1, 3))"""  # fmt: skip


def pair_scores(spark, d):
    """id and pairs: what each pair's model (the difference of two classes' first samples) scores."""
    s = src.samples(spark, d)
    first = s.groupBy("label").agg(F.min_by("q", "id").alias("w"))  # a row a class
    weights = F.zip_with("a.w", "b.w", lambda x, y: x - y)
    near = first.alias("a").join(F.broadcast(first.select(F.explode(F.array(C("label") - 1, C("label") - 3)).alias("at"), "label", "w")).alias("b"), C("a.label") == C("b.at"))
    models = near.agg(F.collect_list(F.struct(F.concat_ws("_", C("a.label").cast("string"), C("b.label").cast("string")).alias("name"), weights.alias("w"))).alias("models"))
    total = lambda w: F.aggregate(F.zip_with("q", w, lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)
    both = s.withColumn("_all", F.lit(1)).join(F.broadcast(models.withColumn("_all", F.lit(1))), "_all")  # one row
    return both.select("id", F.map_from_entries(F.transform("models", lambda m: F.struct(m["name"], total(m["w"])))).alias("pairs"))


@query("t3_tournament", f"""WITH RECURSIVE {PAIRED}, cd AS (SELECT id, class, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS k FROM scr WHERE id % 3 = 0 OR class % 2 = id % 2),
  r AS (SELECT id, k, class, score FROM cd WHERE k = 1 UNION ALL
    SELECT r.id, c.k, CASE WHEN p.s IS NOT NULL THEN CASE WHEN p.s > 0 THEN r.class ELSE c.class END WHEN n.s IS NOT NULL THEN CASE WHEN n.s > 0 THEN c.class ELSE r.class END WHEN r.score < c.score THEN c.class ELSE r.class END,
      CASE WHEN p.s IS NOT NULL THEN abs(p.s) WHEN n.s IS NOT NULL THEN abs(n.s) ELSE greatest(r.score, c.score) END
    FROM r JOIN cd c ON c.id = r.id AND c.k = r.k + 1 LEFT JOIN ps p ON p.id = r.id AND p.c1 = r.class AND p.c2 = c.class LEFT JOIN ps n ON n.id = r.id AND n.c1 = c.class AND n.c2 = r.class)
  SELECT id, class, score FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""", "scr")  # fmt: skip
def t3(spark, d):
    """Classes of the kind allowed (odd, even or any, by id), best first, against the pair models and else by score."""
    allowed = (C("id") % 3 == 0) | (C("class") % 2 == C("id") % 2)
    ranked = F.sort_array(F.collect_list(F.struct((-C("score")).alias("k"), "class", "score")))
    own = src.scores(spark, d).where(allowed).groupBy("id").agg(F.transform(ranked, lambda x: F.struct(x["class"].alias("class"), x["score"].alias("score"))).alias("all"))
    met = own.join(pair_scores(spark, d), "id")
    return met.select("id", op.tournament(C("all"), C("pairs")).alias("w")).select("id", "w.class", "w.score")


def pruned_sql(n: int) -> str:
    """Views up to pr, the letters that prune_letters(votes, n) keeps."""
    return f"""{VOTES}, rk AS (SELECT *, row_number() OVER (PARTITION BY plate_id, pos ORDER BY total DESC, letter) AS rank FROM vo),
  dr AS (SELECT *, lag(total) OVER (PARTITION BY plate_id, pos ORDER BY rank) - total AS fall FROM rk),
  ls AS (SELECT *, max(fall) OVER (PARTITION BY plate_id, pos ORDER BY rank ROWS UNBOUNDED PRECEDING) AS loss FROM dr),
  pr AS (SELECT plate_id, pos, letter, total, rank FROM (SELECT *, round(product(CASE WHEN rank > 1 THEN rank / (rank - 1)::DOUBLE ELSE 1 END)
    OVER (PARTITION BY plate_id ORDER BY loss NULLS FIRST, pos, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before FROM ls) WHERE rank = 1 OR before < {n})"""  # fmt: skip


#: Combinations that the letters of a plate are pruned to, about.
CANDIDATES = 25
TEXTS = f"""{pruned_sql(CANDIDATES)},
  pl AS (SELECT plate_id, dense_rank() OVER (PARTITION BY plate_id ORDER BY pos) AS place, replace(letter, '~', '*') AS sign, total,
    CASE WHEN rank > 1 AND total * 10 < max(total) OVER (PARTITION BY plate_id, pos) * 9 AND letter <> '~' AND pos <> max(pos) OVER (PARTITION BY plate_id) THEN 1 ELSE 0 END AS cost FROM pr),
  nr AS (SELECT plate_id, 1::BIGINT AS place, sign AS text, total, cost FROM pl WHERE place = 1
    UNION ALL SELECT nr.plate_id, pl.place, nr.text || pl.sign, nr.total + pl.total, nr.cost + pl.cost FROM nr JOIN pl ON nr.plate_id = pl.plate_id AND pl.place = nr.place + 1 WHERE nr.cost + pl.cost <= 1),
  nb AS (SELECT plate_id, text, total FROM nr JOIN (SELECT plate_id, max(place) AS place FROM pl GROUP BY 1) USING (plate_id, place))"""  # fmt: skip


def pruned(spark, d, n):
    """Letters that prune_letters keeps; they are spread by plate before they are counted, so nothing is shuffled after that."""
    votes = letter_votes(spread(src.letters(spark, d), ["plate_id"]), LEAST, SKIP)
    return op.prune_letters(votes, n, together=True)


def places(spark, d):
    return op.places(pruned(spark, d, CANDIDATES))


def candidates(spark, d):
    """Texts over all places of each plate, from its pruned letters, with one substitution at most: an array, so that nothing sorts the texts of many plates."""
    return op.combinations(places(spark, d), 1)


def top(spark, d, n):
    """The n best texts of each plate, in order."""
    return candidates(spark, d).select("plate_id", F.slice(op.best_first(C("texts")), 1, n).alias("texts"))


@query("t4_top_plates", f"WITH RECURSIVE {TEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY plate_id ORDER BY total DESC, text) AS rank FROM nb) SELECT plate_id, rank, text, total FROM r WHERE rank <= 3", "let")
def t4(spark, d):
    own = top(spark, d, 3).select("plate_id", F.posexplode("texts").alias("i", "c"))
    return own.select("plate_id", "c.text", "c.total", (C("i") + 1).cast("long").alias("rank"))


@query("t5_prune_letters", f"WITH {pruned_sql(12)} SELECT * FROM pr", "let")
def t5(spark, d):
    return pruned(spark, d, 12)


@query("t6_n_best", f"WITH RECURSIVE {TEXTS} SELECT plate_id, text, total FROM nb", "let")
def t6(spark, d):
    return op.n_best(places(spark, d), 1)


@query("t7_order_boxes", "SELECT det_id, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY x, det_id) AS by_x, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY h, det_id) AS by_h FROM det", "det")
def t7(spark, d):
    rank = lambda c: F.row_number().over(Window.partitionBy(*FRAME).orderBy(c, "det_id")).cast("long")
    return src.detections(spark, d).select("det_id", rank("x").alias("by_x"), rank("h").alias("by_h"))


@query("t8_rescale_scores", f"WITH RECURSIVE {TEXTS} SELECT plate_id, text, round(90.0::DOUBLE * total / max(total) OVER (PARTITION BY plate_id), 4) AS score FROM nb WHERE total > 0", "let")
def t8(spark, d):
    own = candidates(spark, d).select("plate_id", F.filter("texts", lambda c: c["total"] > 0).alias("texts"))
    each = own.select("plate_id", F.array_max(F.transform("texts", lambda c: c["total"])).alias("_top"), F.explode("texts").alias("c"))
    return each.select("plate_id", "c.text", F.round(90.0 * C("c.total") / C("_top"), 4).alias("score"))


@query("t9_plate_result", f"""WITH RECURSIVE {TEXTS}, m AS (SELECT plate_id, text, regexp_full_match(text, '[A-D][A-Z].*') AS ok, row_number() OVER (PARTITION BY plate_id ORDER BY total DESC, text) AS rank FROM nb)
  SELECT plate_id, coalesce(min_by(text, rank) FILTER (ok), max_by(text, rank)) AS text, bool_or(ok) AS matches FROM m GROUP BY 1""", "let")  # fmt: skip
def t9(spark, d):
    """The first text that matches, else the last one, without a match."""
    own = candidates(spark, d).select("plate_id", F.transform(op.best_first(C("texts")), lambda c: c["text"]).alias("texts"))
    own = own.select("plate_id", "texts", F.filter("texts", lambda t: t.rlike("^[A-D][A-Z]")).alias("hits")).where(F.size("texts") > 0)
    last = F.try_element_at("texts", F.lit(-1))
    return own.select("plate_id", F.coalesce(F.try_element_at("hits", F.lit(1)), last).alias("text"), (F.size("hits") > 0).alias("matches"))


@query("k5_format_candidates", f"""WITH RECURSIVE {TEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY plate_id ORDER BY total DESC, text) AS rank FROM nb)
  SELECT plate_id, string_agg(printf('P=%s,S=%d,M=%d;', text, total, CASE WHEN starts_with(text, 'A') THEN 1 ELSE 0 END), '' ORDER BY rank) AS line FROM r WHERE rank <= 3 GROUP BY 1""", "let")  # fmt: skip
def k5(spark, d):
    line = F.transform("texts", lambda x: F.format_string("P=%s,S=%d,M=%d;", x["text"], x["total"], F.when(F.startswith(x["text"], F.lit("A")), 1).otherwise(0)))
    return top(spark, d, 3).where(F.size("texts") > 0).select("plate_id", F.array_join(line, "").alias("line"))
