import pytest

from laurel import MetricConfig
from laurel.config import career, single_year


def test_editions_and_names():
    run = career(("X",), stamp="20210801")
    assert run.label_suffixes == ("60", "96", "20")
    assert run.artifact_name("Table_1_Authors") == (
        "Table_1_Authors_career_2020_wopp_extracted_202108"
    )
    one = single_year(("X",), include_preprints=True, overall_min_year=2000, stamp="20210801")
    assert one.label_suffixes == ("60", "20", "20")
    assert one.artifact_name("T") == "T_singleyr_2020_pubs_since_2000_wpp_extracted_202108"
    assert MetricConfig(("X",), min_cite_year=2005).edition == "2005"


def test_guards():
    with pytest.raises(ValueError):
        MetricConfig(("X",), min_cite_year=1996, overall_min_year=1997)
    with pytest.raises(ValueError):
        MetricConfig(())
    with pytest.raises(TypeError):
        MetricConfig(("X",), min_year="1960")
    with pytest.raises(ValueError):
        MetricConfig(("X",), min_year=2021)


def test_every_parameter_changes_the_fingerprint():
    base = MetricConfig(("X",))
    changed = [
        MetricConfig(("Y",)),
        MetricConfig(("X",), rank_cutoff=5),
        MetricConfig(("X",), subfield_fraction=0.1),
        MetricConfig(("X",), include_preprints=True),
    ]
    assert len({base.fingerprint(), *[c.fingerprint() for c in changed]}) == 5
    assert base.fingerprint("a") != base.fingerprint("b")
