"""Plans of the queries whose lines go through the Siddon projector."""

import pytest

from tomoframe.operators import recon
from tomoframe.plans import extra, files, more, slate, volumes  # noqa: F401

SF = "/root/testdata/sf0.001"
ON_LINES = [
    "adjoint_check",
    "back_project",
    "adjoint_sums",
    "crystal_rays_forward",
    "forward_project",
    "em_ratio",
    "lr_back_h",
    "lr_back_w",
    "lr_forward",
    "lr_dual_update",
    "lrem_dual",
    "lrem_basis",
    "multiray_forward",
    "projectors_by_name",
    "siddon_system_matrix",
    "sparse_forward",
    "tof_weights",
]


class Cut(Exception):
    pass


def _first_cut(df, name, by=None):
    raise Cut(df)


@pytest.mark.parametrize("name", ON_LINES)
def test_crossings_are_not_written_out_in_conditions(spark, monkeypatch, name):
    """Conditions of joins and filters, which are tried for every line, stay free of the crossings; lines are dealt out before."""
    if name.startswith("lrem"):  # these run at once, so the matrix is taken where it is first written
        monkeypatch.setattr(recon, "cut", _first_cut)
    try:
        df = slate.QUERIES[name](spark, SF)
    except Cut as c:
        df = c.args[0]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sort" in plan
    assert not [x for x in plan.splitlines() if ("Filter " in x or "Join " in x) and ("transform(" in x or "array_sort(" in x or "sort_array(" in x)]
    assert "RebalancePartitions" in plan
