import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparlattice.functions import keys, text
from sparlattice.plans import cli
from sparlattice.plans.specs import CalcSpec, EnsureModel, EnsureRefined, Mixture, PrototypeSpec, swap_mixtures

MAP = {"Es": {"Fe": 108}, "B": {"Mg": 108}}


def test_signatures_and_totals():
    assert keys.comp_map_sig(MAP) == "B:{Mg:108},Es:{Fe:108}"
    assert keys.comp_totals({"Es": {"Fe": 10, "Mg": 98}, "B": {"Fe": 5, "Mg": 7}}) == {"Fe": 15, "Mg": 105}
    assert keys.sublattice_sets([MAP, {"Es": {"Al": 1}}]) == {"B": ["Mg"], "Es": ["Al", "Fe"]}
    assert keys.comp_maps_equal(MAP, dict(reversed(MAP.items())))
    with pytest.raises(ValueError):
        keys.comp_maps_equal(MAP, {"Es": {"Fe": 0}})


def test_parsers():
    assert text.cutoffs("2:10,3:8,,4:5") == {2: 10.0, 3: 8.0, 4: 5.0}
    assert text.prototype("doubleperovskite_J0Sr_Q0O") == ("doubleperovskite", {"J0": "Sr", "Q0": "O"})
    m = text.mixture("composition_map=Mg:{Fe:54,Mn:46},Co:{Fe:46,Mn:54};K=50;seed=123")
    assert m["K"] == 50 and m["seed"] == 123
    assert list(Mixture(**m).composition_map) == ["Co", "Mg"]


@pytest.mark.parametrize("bad", ["Fe54", ":3", "Fe:1,Fe:2", "Fe:-1", ""])
def test_bad_counts(bad):
    with pytest.raises(ValueError):
        text.counts(bad)


@pytest.mark.parametrize("bad", ["Es:{Mg:1", "Es:Mg:1}", "Es:{Mg:1},Es:{Mg:2}", ""])
def test_bad_maps(bad):
    with pytest.raises(ValueError):
        text.composition_map(bad)


@pytest.mark.parametrize("bad", ["K=5", "composition_map=Es:{Mg:1}", "composition_map=Es:{Mg:1};K=1;x=2"])
def test_bad_mixtures(bad):
    with pytest.raises(ValueError):
        text.mixture(bad)


@pytest.mark.parametrize("bad", ["nosuch_Q0O", "spinel_Z0O", "spinel_Q0O_Q0O", "spinel"])
def test_bad_prototypes(bad):
    with pytest.raises(ValueError):
        text.prototype(bad)


@pytest.mark.parametrize(("name", "params"), [("spinel", {}), ("spinel", {"a": -1.0}), ("spinel", {"a": 8.0, "z": 1.0}), ("pyrochlore", {"a": 10.0, "x": 1.5})])
def test_bad_parameters(name, params):
    with pytest.raises(ValueError):
        text.parameters(name, params)


@given(st.dictionaries(st.sampled_from(["A", "B", "Es"]), st.dictionaries(st.sampled_from(["Fe", "Mg", "O"]), st.integers(0, 500), min_size=1), min_size=1))
def test_parse_and_signature_are_inverse(m):
    assert text.composition_map(keys.comp_map_sig(m)) == m


def test_structure_key_ignores_site_order_and_whole_shifts():
    a = keys.occ_key(np.eye(3), ["Fe", "Mg"], [[0.1, 0, 0], [0.5, 0.5, 0.5]])
    assert a == keys.occ_key(np.eye(3), ["Mg", "Fe"], [[0.5, -0.5, 0.5], [1.1, 0, 0]])
    assert a != keys.occ_key(np.eye(3), ["Mg", "Fe"], [[0.5, 0.5, 0.5], [0.2, 0, 0]])


def spec(**how):
    proto = PrototypeSpec("spinel_Q0O", {"a": 8.1})
    calc = CalcSpec("vasp-gga; x", "full", "nonmagnetic", 0.02, "Es,Fm")
    mixtures = tuple(swap_mixtures("Mg", "Al", 2, 4, 5))
    return EnsureModel(proto, (1, 1, 1), mixtures, calc, {2: 5.0}, **how)


def test_specs():
    s = spec()
    assert s.prototype.active_sites((2, 2, 2)) == {"Es": 16, "Fm": 32}
    assert s.calc.name == "vasp-gga" and s.calc.model == "x"
    assert s.key == spec(cv_seed=7).key != spec(regularization={"type": "ridge", "alpha": 1.0}).key
    with pytest.raises(ValueError):
        CalcSpec("a", "full", "nonmagnetic", 0.02, "Fm,Es")
    with pytest.raises(ValueError):
        EnsureModel(s.prototype, (1, 1, 1), (Mixture({"Es": {"Mg": 3}}, 1),), s.calc, {2: 5.0})
    end = s.mixtures[0].composition_map
    r = EnsureRefined(s, (end,), {"bin_width": 0.1, "seed": 0}, 100, 5, 10, 0.5)
    assert r.sampled_mixtures == s.mixtures[1:]
    assert r.key() != r.key(partial=True)
    with pytest.raises(ValueError):
        EnsureRefined(s, (end,), {"bin_width": 0.1}, 100, 5, 10).key()


def test_chain_key_depends_on_the_grid_but_not_on_tiny_noise():
    key = lambda w: keys.wl_key("c", w, "swap", MAP, True, 100, 1, 0)
    assert key(0.1) == key(0.1 + 1e-15) != key(0.2)


def test_command_line(capsys):
    args = ["ensure-model", "--prototype", "spinel_Q0O", "--param", "a=8.1", "--supercell", "1", "1", "1", "--mix", "composition_map=Es:{Mg:1,Al:1},Fm:{Mg:1,Al:3};K=5", "--cutoffs", "2:5", "--calculator", "vasp-gga"]
    out = cli.main(args)
    assert json.loads(capsys.readouterr().out) == out
    more = cli.main(["ensure-refined", *args[1:], "--endpoint", "Es:{Mg:2},Fm:{Al:4}", "--bin-width", "0.1", "--steps", "10", "--samples-per-bin", "2", "--budget", "5", "--min-partial-frac", "0.5"])
    assert more["sampled"] == 1 and len({more["ce_key"], more["partial_ce_key"], more["base_ce_key"]}) == 3


def test_specs_come_back_from_their_documents():
    import dataclasses

    from sparlattice.operators.sampling import SamplerSpec
    from sparlattice.plans import specs

    base = spec(regularization={"type": "ridge", "alpha": 1.0}, weighting={"scheme": "balance_by_comp", "alpha": 0.5})
    refined = EnsureRefined(base, (base.mixtures[0].composition_map,), {"bin_width": 0.1, "seed": 0}, 100, 5, 10, 0.5, CalcSpec("vasp-24", "static", "afm", 0.1))
    for one in (base, refined, refined.final, base.prototype, base.mixtures[0], SamplerSpec(0.1, 10, production_mode=True)):
        back = specs.from_document(json.loads(json.dumps(specs.document(one))))
        assert specs.document(back) == specs.document(one) and type(back) is type(one)
    assert specs.from_document(json.loads(json.dumps(specs.document(refined)))).key() == refined.key()
    calc = specs.document(refined.final)
    for bad in (calc | {"kind": "nosuch"}, calc | {"more": 1}, {k: v for k, v in calc.items() if k != "calculator"}, calc | {"relax_type": "half"}):
        with pytest.raises(ValueError):
            specs.from_document(bad)
    assert dataclasses.is_dataclass(specs.from_document({k: v for k, v in calc.items() if k != "frozen_sublattices"}))
