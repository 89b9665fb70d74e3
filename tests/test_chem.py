import random

import pytest

from routeloom.functions import chem
from routeloom.plans.kernel import ESTER, MOLECULES

SPELLINGS = [
    ("CC(C)CO", "OCC(C)C", "[CH3:7][CH:2]([CH3:4])[CH2:9][OH:1]"),
    ("Clc1ccccc1", "c1cccc(Cl)c1"),
    ("COc1ccc(C=O)cc1", "O=Cc1ccc(OC)cc1"),
    ("C1CCOC1.Br", "Br.O1CCCC1"),
    ("Fc1cc2ccccc2[nH]1", "[nH]1c(F)cc2ccccc12"),
]


@pytest.mark.parametrize("same", SPELLINGS)
def test_spellings_of_one_molecule(same):
    texts = {chem.canonicalize(s) for s in same}
    assert len(texts) == 1 and None not in texts and len({chem.key(s) for s in same}) == 1


def test_unreadable_texts():
    for bad in ("?", " ", None, "CC)C", "N1CCC", "[Qx]", "F(F)F"):
        assert chem.canonicalize(bad) is None and chem.key(bad) is None and chem.heavy_atoms(bad or "?") is None


def test_any_atom_order_is_written_alike():
    rnd = random.Random(2)
    for smiles in ("CCOC(=O)c1ccco1", "C1CC2CC1CC2", "CN1CCN(CC1)c1ncccn1", "O=S(=O)(Cl)CCCBr"):
        g = chem.parse(smiles)
        for _ in range(10):
            order = list(range(len(g.atoms)))
            rnd.shuffle(order)
            assert chem.write(g.only(order)) == chem.canonicalize(smiles)


def test_parts_and_reactions():
    assert chem.components("CCCl.NCC") == [chem.canonicalize("CCCl"), chem.canonicalize("CCN")]
    assert chem.components("CCCl..C(") == [chem.canonicalize("CCCl")]
    assert [len(x) for x in chem.parse_reaction("CCBr.CN>O>CCNC")] == [2, 1, 1]
    assert chem.parse_reaction("CCBr") is None and chem.parse_reaction("a>b>c>d") is None
    assert chem.largest_fragment("Br.O1CCCC1.C") == chem.canonicalize("C1CCOC1")


def test_templates():
    acid, alcohol = chem.canonicalize("CCC(=O)O"), chem.canonicalize("CO")
    assert [set(r) for r, _ in chem.apply_template(ESTER, "CCC(=O)OC")] == [{acid, alcohol}]
    for product in ("CCCCl", "CCC(=O)NC", "broken("):
        assert chem.apply_template(ESTER, product) == []
    for bad in ("", "C>>", "[C:1]>[C:1]", "[N:1].[N:2]>>[N:1][N:2]", "[Jj]>>N"):
        assert chem.apply_template(bad, "CCC(=O)OC") == []
    assert chem.apply_template_forward(ESTER, "CO.CCC(=O)O") == [chem.canonicalize("CCC(=O)OC")]
    assert chem.apply_template_forward(ESTER, "CO") == []
    assert chem.apply_template_forward(ESTER, ".".join(["CO"] * 12)) == []


def test_toy_molecules():
    for smiles, _, atoms, bonds, radical in MOLECULES:
        g = chem.parse(smiles)
        assert (len(g.atoms), sum(map(len, g.bonds.values())) // 2, chem.has_radical(smiles)) == (atoms, bonds, radical)
    assert not chem.has_radical("C[S-]") and not chem.has_radical("CC[NH3+]")


def test_functions_in_sql(spark):
    from routeloom.functions import udf

    udf.register(spark)
    r = spark.sql("SELECT canonical_smiles('OCC(C)C') = canonical_smiles('CC(C)CO') AS same, heavy_atoms('CC(C)CO') AS n, mol_key('?') AS k").first()
    assert (r.same, r.n, r.k) == (True, 5, None)
