"""Species and run settings: plain documents checked strictly before any data is read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


def _strict(cls, doc: dict, where: str):
    known = {f.name for f in fields(cls)}
    extra = set(doc) - known
    if extra:
        raise ValueError(f"{where}: unknown keys {sorted(extra)}; known: {sorted(known)}")
    return cls(**doc)


@dataclass
class Subgenome:
    id: str
    chroms: list[str]
    name: str = ""


@dataclass
class GenoSource:
    vcf: str | None = None
    vcf_dir: str | None = None
    bed_root: str | None = None

    def __post_init__(self):
        if sum(x is not None for x in (self.vcf or self.vcf_dir, self.bed_root)) != 1:
            raise ValueError("give exactly one genotype source: vcf (file or directory) or bed_root")


@dataclass
class QC:
    maf: float = 0.01
    geno: float = 0.1
    hwe: float | None = None


@dataclass
class SpeciesConfig:
    species: str
    ploidy: int
    kind: str
    subgenomes: list[Subgenome]
    geno: GenoSource
    qc: QC = field(default_factory=QC)
    provenance: dict = field(default_factory=dict)

    def __post_init__(self):
        ids = [s.id for s in self.subgenomes]
        if self.kind == "diploid" and (len(ids) != 1 or self.ploidy != 2):
            raise ValueError("a diploid has one subgenome and ploidy 2")
        if self.kind == "allopolyploid" and len(ids) < 2:
            raise ValueError("an allopolyploid has at least two subgenomes")
        if len(set(ids)) != len(ids):
            raise ValueError("subgenome ids must be unique")
        all_chroms = [c for s in self.subgenomes for c in s.chroms]
        twice = sorted({c for c in all_chroms if all_chroms.count(c) > 1})
        if twice:
            raise ValueError(f"chromosomes in two subgenomes: {twice}")


def species_config(doc: dict) -> SpeciesConfig:
    d = dict(doc)
    d["subgenomes"] = [_strict(Subgenome, x, "subgenome") for x in d.get("subgenomes", [])]
    d["geno"] = _strict(GenoSource, d.get("geno", {}), "geno")
    d["qc"] = _strict(QC, d.get("qc", {}), "qc")
    return _strict(SpeciesConfig, d, "species config")


def load_document(path: str) -> dict:
    """JSON, or YAML where a YAML package is installed."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; give a .json file instead") from e
    return yaml.safe_load(text)


def load_run_config(path: str) -> dict:
    """Run settings; ``panel_manifest`` (beside the config, else in the working folder) gives defaults."""
    cfg = load_document(path)
    ref = cfg.pop("panel_manifest", None)
    if ref:
        for base in (Path(path).parent, Path.cwd()):
            if (base / ref).exists():
                return {**load_document(str(base / ref)), **cfg}
        raise FileNotFoundError(f"panel_manifest {ref} not found beside {path} or in the working folder")
    return cfg


def check_species(cfg: SpeciesConfig, present: set[str]) -> list[str]:
    """Declared chromosomes that the data does not have."""
    return sorted({c for s in cfg.subgenomes for c in s.chroms} - present)
