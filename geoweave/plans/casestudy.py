"""The case study: polarisation of districts joined with structure, infrastructure and transit.

Tables are named inputs, however many stores they come from: what a federated query asks of another
endpoint is here another DataFrame in the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import centred, optional
from ..operators.spatial_join import multi_nearest, spatial_join

# Names of parties in the manifesto table, federal states of the east.
PARTY_NAMES = (("CDU|CSU", "CDU/CSU"), ("DIE LINKE", "LINKE"), ("GRÜNE", "90/Greens"))
EAST = "^Brandenburg|Mecklenburg-Vorpommern|Sachsen(-Anhalt)?|Thüringen$"


def manifesto_name(party: Column) -> Column:
    for pattern, name in PARTY_NAMES:
        party = F.regexp_replace(party, pattern, name)
    return party


def party_votes(results: DataFrame, elections: DataFrame, manifesto: DataFrame) -> DataFrame:
    """(election, area_no, area_name, body, party, votes, rile) of parties with a manifesto position."""
    kind = F.when(F.col("body") == "EP", "Kreis").otherwise("Wahlkreis")
    vote = F.when(F.col("body") == "BT", 2).otherwise(1)
    own = results.filter((F.col("candidate_type") == "Partei") & (F.col("area_type") == kind) & (F.col("vote_type") == vote))
    own = own.withColumn("party", manifesto_name(F.col("candidate_name"))).join(elections.select("election", "date", "countryname"), "election")
    by = manifesto.select(F.col("election"), F.col("edate").alias("date"), "countryname", F.col("partyabbrev").alias("party"), "rile")
    both = own.join(by, ["election", "date", "countryname", "party"])
    return both.groupBy("election", "area_no", "party").agg((F.sum("votes_percent") / 100).alias("votes"), F.min("rile").alias("rile"), F.min("area_name").alias("area_name"), F.min("body").alias("body"))


def polarisation(votes: DataFrame) -> DataFrame:
    """(election, area_no, area_name, body, pasysav, polarization, other_votes)."""
    names = votes.groupBy("election", "area_no").agg(F.min("area_name").alias("area_name"), F.min("body").alias("body"))
    spread = centred(votes, ["election", "area_no"], "votes", "rile", "pasysav", "polarization").withColumnRenamed("other", "other_votes")
    return names.join(spread, ["election", "area_no"])


def structure(table: DataFrame) -> DataFrame:
    return table.withColumns({"log_pop_density": F.when(F.col("pop_density") > 0, F.ln("pop_density")), "age_over60": F.col("age_60_74") + F.col("age_over74"), "east": F.col("state").rlike(EAST)})


def infrastructure(buildings: DataFrame, rights: dict[str, DataFrame], **options) -> DataFrame:
    """Per (election, area_no): buildings and mean and deviation of their distance to the nearest of each set."""
    near = multi_nearest(buildings, rights, left_id="id", **options)
    keyed = buildings.select(F.col("id").alias("left_id"), "election", "area_no").join(near, "left_id")
    aggs = [f(f"dist_{n}").alias(f"{k}_dist_{n}") for n in rights for k, f in (("avg", F.avg), ("sd", F.stddev_samp))]
    return keyed.groupBy("election", "area_no").agg(F.count("*").alias("count_buildings"), *aggs)


def transit(buildings: DataFrame, stops: DataFrame, max_distance_m: float = 300) -> DataFrame:
    """Per (election, area_no): mean over buildings of the trips at stops within reach, 0 where there is none."""
    reach = spatial_join(buildings, stops, max_distance_m=max_distance_m, left_id="id", right_id="id", payload=["n_trips"], left_columns=())
    trips = reach.groupBy("left_id").agg(F.sum("n_trips").alias("n"))
    all_ = buildings.select(F.col("id").alias("left_id"), "election", "area_no").distinct().join(trips, "left_id", "left")
    return all_.groupBy("election", "area_no").agg(F.count("*").alias("count_buildings_transit"), F.avg(F.coalesce("n", F.lit(0))).alias("avg_trips"))


def case_study(results: DataFrame, elections: DataFrame, manifesto: DataFrame, structural: DataFrame | None = None, infra: DataFrame | None = None, reach: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """A row per district with all that is known of it, by area number."""
    out = polarisation(party_votes(results, elections, manifesto)).join(elections.select("election", F.col("label").alias("election_name")), "election")
    for part in (structure(structural) if structural is not None else None, infra, reach):
        if part is not None:
            out = optional(out, part)
    out = out.orderBy("area_no", "election")
    return out if limit is None else out.limit(limit)
