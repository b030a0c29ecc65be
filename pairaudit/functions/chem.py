"""Chemistry functions; they need RDKit, which this package does not require.

Each runs on the distinct structures of a column and is joined back, so a
structure is parsed once however many records name it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from rdkit import Chem
    from rdkit.Chem import Descriptors, rdFingerprintGenerator, rdMolDescriptors
except ImportError:  # optional
    Chem = None

DESCRIPTORS = ("MolWt", "MolLogP", "TPSA", "NumHDonors", "NumHAcceptors", "NumRotatableBonds", "RingCount", "FractionCSP3")


def available() -> bool:
    return Chem is not None


def _needed() -> None:
    if Chem is None:
        raise ImportError("RDKit is not installed")


def _per_structure(df: DataFrame, smiles: str, name: str, function, kind: str) -> DataFrame:
    _needed()
    udf = F.pandas_udf(function, kind)
    known = df.select(smiles).distinct().withColumn(name, udf(smiles))
    return df.join(known, smiles, "left")


def with_heavy_atoms(df: DataFrame, smiles: str, name: str = "heavy") -> DataFrame:
    """Heavy atoms; -1 null, 0 empty, -2 not readable."""

    def count(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return -1
            if not x.strip():
                return 0
            mol = Chem.MolFromSmiles(x)
            return -2 if mol is None else mol.GetNumHeavyAtoms()

        return s.map(one)

    return _per_structure(df, smiles, name, count, "int")


def with_canonical(df: DataFrame, smiles: str, name: str = "canonical") -> DataFrame:
    """Canonical isomeric form; null if not readable."""

    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: Chem.MolToSmiles(m) if x and (m := Chem.MolFromSmiles(x)) else None)

    return _per_structure(df, smiles, name, form, "string")


def with_on_bits(df: DataFrame, smiles: str, name: str = "on_bits", radius: int = 2, size: int = 1024) -> DataFrame:
    """On-bits of the circular fingerprint."""

    def bits(s: pd.Series) -> pd.Series:
        maker = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=size)
        return s.map(lambda x: list(maker.GetFingerprint(m).GetOnBits()) if x and (m := Chem.MolFromSmiles(x)) else [])

    return _per_structure(df, smiles, name, bits, "array<int>")


def with_descriptors(df: DataFrame, smiles: str, name: str = "descriptors") -> DataFrame:
    """Physico-chemical descriptors; one that fails is 0."""

    def values(s: pd.Series) -> pd.Series:
        def one(x):
            mol = Chem.MolFromSmiles(x) if x else None
            out = []
            for d in DESCRIPTORS:
                try:
                    out.append(float(getattr(Descriptors, d)(mol)))
                except Exception:  # a descriptor that can't be had counts as 0
                    out.append(0.0)
            return out

        return s.map(one)

    return _per_structure(df, smiles, name, values, "array<double>")


def with_substructure_counts(df: DataFrame, smiles: str, patterns: dict[str, str], name: str = "counts") -> DataFrame:
    """Matches of each SMARTS pattern, as a map."""

    def counts(s: pd.Series) -> pd.Series:
        queries = {k: Chem.MolFromSmarts(v) for k, v in patterns.items()}

        def one(x):
            mol = Chem.MolFromSmiles(x) if x else None
            return {k: len(mol.GetSubstructMatches(q)) if mol else 0 for k, q in queries.items()}

        return s.map(one)

    return _per_structure(df, smiles, name, counts, "map<string,int>")


def with_formula(df: DataFrame, smiles: str, name: str = "formula") -> DataFrame:
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: rdMolDescriptors.CalcMolFormula(m) if x and (m := Chem.MolFromSmiles(x)) else None)

    return _per_structure(df, smiles, name, form, "string")
