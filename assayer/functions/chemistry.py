"""Structure functions, for where a chemistry toolkit (RDKit) is installed.

The toolkit is imported inside the factories, so this module always loads; the
registry leaves out what can't be imported. Everything beyond this file works on
what these functions give: strings, bit positions, bags of strings, numbers.
They are not exercised where the toolkit is missing.
"""

from __future__ import annotations

from assayer.functions.registry import ScoringFunction

DESCRIPTORS = (
    "MolWt", "HeavyAtomMolWt", "CLogP", "TPSA", "QED", "RingCount", "NumAromaticRings", "NumAliphaticRings", "NumRotatableBonds", "NumHAcceptors", "NumHDonors", "HeavyAtomCount",
    "NumHeteroatoms", "FractionCSP3", "FormalCharge", "BertzCT", "FluorineCount",
)


def _each(parse, one):
    """A batch function over strings: {} where a string can't be parsed."""

    def call(strings):
        out = []
        for s in strings:
            mol = parse(s)
            out.append({} if mol is None else one(mol))
        return out

    return call


def descriptors() -> ScoringFunction:
    from rdkit import Chem, RDLogger
    from rdkit.Chem import QED, Crippen, Descriptors, GraphDescriptors, rdMolDescriptors

    RDLogger.DisableLog("rdApp.*")

    def one(m):
        return {
            "MolWt": Descriptors.MolWt(m), "HeavyAtomMolWt": Descriptors.HeavyAtomMolWt(m), "CLogP": Crippen.MolLogP(m), "TPSA": rdMolDescriptors.CalcTPSA(m), "QED": QED.qed(m),
            "RingCount": rdMolDescriptors.CalcNumRings(m), "NumAromaticRings": rdMolDescriptors.CalcNumAromaticRings(m), "NumAliphaticRings": rdMolDescriptors.CalcNumAliphaticRings(m),
            "NumRotatableBonds": rdMolDescriptors.CalcNumRotatableBonds(m), "NumHAcceptors": rdMolDescriptors.CalcNumHBA(m), "NumHDonors": rdMolDescriptors.CalcNumHBD(m),
            "HeavyAtomCount": m.GetNumHeavyAtoms(), "NumHeteroatoms": rdMolDescriptors.CalcNumHeteroatoms(m), "FractionCSP3": rdMolDescriptors.CalcFractionCSP3(m),
            "FormalCharge": Chem.GetFormalCharge(m), "BertzCT": GraphDescriptors.BertzCT(m), "FluorineCount": sum(a.GetSymbol() == "F" for a in m.GetAtoms()),
        }

    return ScoringFunction("StructureDescriptors", DESCRIPTORS, lambda **_: _each(Chem.MolFromSmiles, one), "arrow")


def substructures() -> ScoringFunction:
    """match: 1 if any (or all) of the SMARTS patterns match."""
    from rdkit import Chem

    def build(smarts=(), mode="any", **_):
        patterns = [Chem.MolFromSmarts(s) for s in smarts]
        fold = any if mode == "any" else all
        return _each(Chem.MolFromSmiles, lambda m: {"match": int(fold(m.HasSubstructMatch(p) for p in patterns))})

    return ScoringFunction("SubstructureMatch", ("match",), build, "arrow")


def substructure_filters() -> ScoringFunction:
    """pass: 0 if any of the SMARTS patterns matches."""
    from rdkit import Chem

    def build(smarts=(), **_):
        patterns = [Chem.MolFromSmarts(s) for s in smarts]
        return _each(Chem.MolFromSmiles, lambda m: {"pass": int(not any(m.HasSubstructMatch(p) for p in patterns))})

    return ScoringFunction("SubstructureFilters", ("pass",), build, "arrow")


def fingerprint_similarity() -> ScoringFunction:
    """Sim: mean or max Tanimoto or Dice similarity of Morgan prints to references."""
    from rdkit import Chem, DataStructs
    from rdkit.Chem import rdFingerprintGenerator

    def build(references=(), method="max", radius=2, bits=2048, measure="Tanimoto", **_):
        make = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=bits).GetFingerprint
        known = [make(m) for m in map(Chem.MolFromSmiles, references) if m is not None]
        bulk = DataStructs.BulkTanimotoSimilarity if measure == "Tanimoto" else DataStructs.BulkDiceSimilarity

        def one(m):
            s = bulk(make(m), known)
            return {"Sim": max(s) if method == "max" else sum(s) / len(s)}

        return _each(Chem.MolFromSmiles, one)

    return ScoringFunction("MolecularSimilarity", ("Sim",), build, "arrow")


FUNCTIONS = {
    "StructureDescriptors": descriptors,
    "SubstructureMatch": substructures,
    "SubstructureFilters": substructure_filters,
    "MolecularSimilarity": fingerprint_similarity,
}


def producers() -> dict:
    """Functions from a SMILES string to what the operators work on; raises ImportError without the toolkit.

    canonical, neutral, scaffold, generic_scaffold, formula: a string or None;
    bits: positions; fragments, rings: bags of strings.
    """
    from rdkit import Chem
    from rdkit.Chem import BRICS, rdFingerprintGenerator, rdMolDescriptors
    from rdkit.Chem.MolStandardize import rdMolStandardize
    from rdkit.Chem.Scaffolds import MurckoScaffold

    morgan = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=2048)

    def on(f, none=None):
        def g(s):
            m = Chem.MolFromSmiles(s) if s else None
            return none if m is None else f(m)

        return g

    def ring_systems(m):
        systems: list[set] = []
        for ring in map(set, m.GetRingInfo().AtomRings()):
            joined = [x for x in systems if x & ring]
            systems = [x for x in systems if not x & ring] + [ring.union(*joined)]
        return [Chem.MolFragmentToSmiles(m, atomsToUse=sorted(x)) for x in systems]

    return {
        "canonical": on(Chem.MolToSmiles),
        "neutral": on(lambda m: Chem.MolToSmiles(rdMolStandardize.Uncharger().uncharge(m))),
        "scaffold": on(lambda m: Chem.MolToSmiles(MurckoScaffold.GetScaffoldForMol(m)), ""),
        "generic_scaffold": on(lambda m: Chem.MolToSmiles(MurckoScaffold.MakeScaffoldGeneric(MurckoScaffold.GetScaffoldForMol(m))), ""),
        "formula": on(rdMolDescriptors.CalcMolFormula),
        "bits": on(lambda m: list(morgan.GetFingerprint(m).GetOnBits()), []),
        "fragments": on(lambda m: sorted(BRICS.BRICSDecompose(m)), []),
        "rings": on(ring_systems, []),
    }
