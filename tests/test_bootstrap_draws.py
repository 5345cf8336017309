"""The registered intervals draw as often as the parameters say."""

from compare import canonical
from vociflow.operators import bootstrap
from vociflow.params import DEFAULT
from vociflow.plans import adapters, catalog


def test_registered_intervals_use_all_draws(spark, sf_dir):
    samples = bootstrap.score_samples(adapters.authors(spark, sf_dir), adapters.posts(spark, sf_dir), adapters.comments(spark, sf_dir))
    found = bootstrap.intervals(samples, DEFAULT.bootstrap, DEFAULT.bootstrap_outer, DEFAULT.bootstrap_inner).localCheckpoint()
    assert canonical(catalog.boot_two_level_ci(spark, sf_dir)) == canonical(catalog.rounded(found))
    assert canonical(catalog.ci_width(spark, sf_dir)) == canonical(catalog.rounded(bootstrap.mean_width(found)))
