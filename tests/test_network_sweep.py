"""The sweep scores every tile with every network of the registry."""

from partita.operators.models import MODELS
from partita.plans.extra_queries import network_sweep


def test_every_network_scores_every_tile(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert {r.model: r.n for r in network_sweep(spark, sf).collect()} == dict.fromkeys(MODELS, n)
