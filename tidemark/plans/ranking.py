"""How well the features rank filings by later revision: knowing the past only, against knowing all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluation, learning, newton
from tidemark.plans import features
from tidemark.plans.registry import ORACLES, query
from tidemark.plans.features import NAIVE, PIT, SOURCES
from tidemark.sources.store import drop, written

_SPLIT = "1997-01-01"
_FEATURES = ["filing_lag_days", "is_large_accelerated_filer", "is_accelerated_filer", "is_non_accelerated_filer", "custom_tag_share", "prior_restatement_count", "sector_restatement_rate"]


def _past(spark, sf) -> DataFrame:
    return features.pit(spark, sf).select("adsh", "filed_date", "was_restated", *_FEATURES, (F.col("sector_prior_resolved_filings") > 0).alias("has_history"))


def _all(spark, sf) -> DataFrame:
    return features.m29_feature_naive(spark, sf).select("adsh", "filed_date", "was_restated", *_FEATURES)


def _both(spark, sf) -> DataFrame:
    """The rows of both kinds of knowledge, by `knowledge`; those that know all have their report's `has_history` beside them."""
    past = _past(spark, sf)
    known = _all(spark, sf).join(past.select("adsh", "has_history"), "adsh")
    return past.withColumn("knowledge", F.lit("past")).unionByName(known.withColumn("knowledge", F.lit("all"))).drop("adsh")


@query(f"""with p as ({ORACLES["m28_feature_pit"]}), n as ({ORACLES["m29_feature_naive"]})
    select count(p.adsh) as n_past, count(n.adsh) as n_all, count(*) filter (where n.adsh is null) as n_only_past, count(*) filter (where p.adsh is null) as n_only_all, count(*) filter (where p.was_restated <> n.was_restated) as n_other_label
    from p full outer join n on n.adsh = p.adsh""")
def ml01_population(spark, sf):
    """Both feature tables must hold the same filings with the same labels."""
    p = _past(spark, sf).select("adsh", F.col("was_restated").alias("a"), F.lit(1).alias("past"))
    n = _all(spark, sf).select("adsh", F.col("was_restated").alias("b"), F.lit(1).alias("all"))
    return p.join(n, "adsh", "full_outer").agg(
        F.count("past").alias("n_past"), F.count("all").alias("n_all"), F.count_if(F.col("all").isNull()).alias("n_only_past"), F.count_if(F.col("past").isNull()).alias("n_only_all"), F.count_if(F.col("a") != F.col("b")).alias("n_other_label")
    )


@query(f"""with {SOURCES} select filed_date >= date '{_SPLIT}' as is_test, count(*) as n, count(*) filter (where was_restated) as n_restated from base group by 1""")
def ml02_split(spark, sf):
    return features.base(spark, sf).groupBy((F.col("filed_date") >= F.lit(_SPLIT).cast("date")).alias("is_test")).agg(F.count("*").alias("n"), F.count_if("was_restated").alias("n_restated"))


@query(f"""with {SOURCES}, {PIT}, {NAIVE}, r as (select unnest(['all', 'warm']) as regime),
    u as (select 'past' as knowledge, adsh, filed_date, was_restated, {", ".join(_FEATURES)}, sector_prior_resolved_filings > 0 as has_history from pit
        union all select 'all', n.adsh, n.filed_date, n.was_restated, {", ".join("n." + f for f in _FEATURES)}, p.sector_prior_resolved_filings > 0 from naive n join pit p using (adsh))
    select regime, knowledge, filed_date >= date '{_SPLIT}' as is_test, count(*) as n, count(*) filter (where was_restated) as n_restated, {", ".join(f"round(avg({f}::double), 6) as mean_{f}" for f in _FEATURES)}
    from u, r where regime = 'all' or has_history or filed_date >= date '{_SPLIT}' group by 1, 2, 3""")
def ml05_regime_rows(spark, sf):
    """What each model learns from and is tested on: rows, labels and means of the features. `warm` trains without reports whose sector has no history."""
    both = _both(spark, sf)
    test = F.col("filed_date") >= F.lit(_SPLIT).cast("date")
    rows = both.withColumn("regime", F.explode(F.array(F.lit("all"), F.lit("warm")))).where((F.col("regime") == "all") | F.col("has_history") | test)
    return rows.groupBy("regime", "knowledge", test.alias("is_test")).agg(F.count("*").alias("n"), F.count_if("was_restated").alias("n_restated"), *(F.round(F.avg(F.col(f).cast("double")), 6).alias(f"mean_{f}") for f in _FEATURES))


def _melted(spark, sf) -> DataFrame:
    one = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in _FEATURES]
    return _past(spark, sf).select("was_restated", F.inline(F.array(*one)))


@query(f"""with p as ({ORACLES["m28_feature_pit"]}), u as ({" union all ".join(f"select '{f}' as feature, {f}::double as score, was_restated from p" for f in _FEATURES)}),
    s as (select feature, score, count(*) filter (where was_restated) as pos, count(*) filter (where not was_restated) as neg from u where score is not null group by 1, 2),
    w as (select feature, pos, neg, coalesce(sum(neg) over (partition by feature order by score rows between unbounded preceding and 1 preceding), 0) as below from s),
    a as (select feature, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg, sum(pos * (2 * below + neg))::double / nullif(2.0 * sum(pos) * sum(neg), 0)::double as area from w group by 1)
    select feature, n_pos, n_neg, round(area, 6) as auc, round(greatest(area, 1 - area), 6) as mirrored_auc from a""")
def ml04b_univariate_aucs(spark, sf):
    """How well each feature alone ranks filings, all in one pass."""
    return evaluation.aucs(_melted(spark, sf), ["feature"], "score", "was_restated")


def sweep(spark, sf) -> DataFrame:
    """Reports of every horizon of the sweep with the features that a reader knew under it, all horizons in one pass.

    A horizon is part of the keys of the prior counts: sectors, companies and the market have a history for each.
    """
    return features.point_in_time_by(features.periodic(spark, sf), features.last_filed(spark, sf), features._HORIZONS)


_TRAINED = f"filed_date < date '{_SPLIT}'"
_PASTS = " union all ".join(f"""select {h} as horizon, b{h}.adsh, was_restated, b{h}.filed_date, (select count(*) from b{h} e where e.cik = b{h}.cik and e.revision_first_seen_date < b{h}.filed_date) as prior_restatement_count,
    case when sic_major_group_at_filing is null then 0 else (select count(*) from b{h} e where e.sic_major_group_at_filing = b{h}.sic_major_group_at_filing and e.filed_date + {h} < b{h}.filed_date) end as sector_n,
    case when sic_major_group_at_filing is null then 0 else (select count(*) from b{h} e where e.sic_major_group_at_filing = b{h}.sic_major_group_at_filing and e.was_restated and e.filed_date + {h} < b{h}.filed_date) end as sector_hit,
    (select count(*) from b{h} e where e.filed_date + {h} < b{h}.filed_date) as market_n, (select count(*) from b{h} e where e.was_restated and e.filed_date + {h} < b{h}.filed_date) as market_hit from b{h}""" for h in features._HORIZONS)


@query(f"""with {SOURCES}, {", ".join(f"b{h} as (select *, coalesce(revision_first_seen_date <= filed_date + {h}, false) as was_restated from periodic where filed_date + {h} <= (select max(filed_date) from sub))" for h in features._HORIZONS)},
    u as ({_PASTS}), v as (select *, round(coalesce(case when sector_n > 0 then sector_hit / sector_n end, case when market_n > 0 then market_hit / market_n end, 0), 6) as rate from u)
    select horizon, filed_date >= date '{_SPLIT}' as is_test, count(*) as n, count(*) filter (where was_restated) as n_restated, sum(prior_restatement_count)::bigint as prior_restatements, sum(sector_n)::bigint as sector_resolved, sum(market_n)::bigint as market_resolved, round(avg(rate), 6) as mean_rate from v group by 1, 2""")
def d21b_horizon_features(spark, sf):
    """The features of the sweep: what was known under each horizon, in training and in test years."""
    test = (F.col("filed_date") >= F.lit(_SPLIT).cast("date")).alias("is_test")
    return sweep(spark, sf).groupBy("horizon", test).agg(
        F.count("*").alias("n"), F.count_if("was_restated").alias("n_restated"), F.sum("prior_restatement_count").alias("prior_restatements"), F.sum("sector_prior_resolved_filings").alias("sector_resolved"), F.sum("market_prior_resolved_filings").alias("market_resolved"), F.round(F.avg("sector_restatement_rate"), 6).alias("mean_rate")
    )


@query()
def d21c_horizon_models(spark, sf):
    """Areas under the curve by horizon and regime, in training and test years; all models are fitted together."""
    rows = sweep(spark, sf).withColumn("regime", F.explode(F.array(F.lit("all"), F.lit("warm")))).withColumn("side", F.when(F.expr(_TRAINED), "train").otherwise("test"))
    rows = written(rows.where("regime = 'all' or sector_prior_resolved_filings > 0 or side = 'test'").select("horizon", "regime", "side", "was_restated", *_FEATURES), "sweep")
    groups = ["horizon", "regime"]
    fits = newton.fit(rows.where("side = 'train'"), groups, _FEATURES, "was_restated")
    areas = evaluation.aucs(newton.scored(rows, groups, _FEATURES, fits), [*groups, "side"], "score", "was_restated")
    return areas.groupBy(*groups).pivot("side", ["train", "test"]).agg(F.first("auc")).select(*groups, F.col("train").alias("train_auc"), F.col("test").alias("test_auc"))


def _models(both: DataFrame) -> list[tuple]:
    """(regime, knowledge, model, training rows, test rows) of all four fits; a model is None where a label is missing.

    Each fit and each area reads the rows several times; give them written.
    """
    is_test, out = F.col("filed_date") >= F.lit(_SPLIT).cast("date"), []
    for regime in ("all", "warm"):
        for knowledge in ("past", "all"):
            rows = both.where(F.col("knowledge") == knowledge)
            train = rows.where(~is_test & (F.col("has_history") if regime == "warm" else F.lit(True)))
            out.append((regime, knowledge, learning.fit_logistic(train, _FEATURES, "was_restated"), train, rows.where(is_test)))
    return out


@query()
def ml03_regimes(spark, sf):
    """Areas under the curve of a logistic model in training and test years, for each kind of knowledge.

    `gap` is what knowing the future seems to add. Areas are null where a side lacks a label.
    """
    areas: dict[str, list] = {}
    both = written(_both(spark, sf), "regimes")
    for regime, _, model, *sides in _models(both):
        areas.setdefault(regime, []).extend(evaluation.auc(learning.score_logistic(model, side, _FEATURES), "score", "was_restated").first()["auc"] if model else None for side in sides)
    drop(both)
    out = [(regime, *found, None if None in (found[1], found[3]) else round(found[3] - found[1], 6)) for regime, found in areas.items()]
    return spark.createDataFrame(out, "regime string, past_train_auc double, past_test_auc double, all_train_auc double, all_test_auc double, gap double")


@query()
def ml03b_coefficients(spark, sf):
    """What each feature, standardised, adds in each of the models."""
    both = written(_both(spark, sf), "regimes")
    rows = [(regime, knowledge, f, round(float(c), 6)) for regime, knowledge, model, *_ in _models(both) if model for f, c in zip(_FEATURES, model.stages[-1].coefficients, strict=True)]
    drop(both)
    return spark.createDataFrame(rows, "regime string, knowledge string, feature string, coefficient double")
