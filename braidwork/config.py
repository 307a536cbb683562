"""Parameters of a run, as one immutable object that functions take explicitly."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    name: str = "out"
    ali: str | None = None
    seq: str | None = None
    pdblist: str | None = None
    pdbdir: str = ""
    pdbdir2: str = ""
    pdbext: str = ".pdb"
    func: str | None = None
    seq_thr: float = 0.95
    str_thr: float = 0.97
    si_thr: float = 0.10
    norm: str = "min"
    outgroup: str = "PC"
    shift_max: int = 9
    s0: float = 0.05
    tm0: float = 0.167
    d_max: float = 10.0
    contact_cutoff: float = 4.5
    contact_separation: int = 3
    rounds: int = 3
    msa_rounds: int = 9
    clique: bool = False
    chain_num: bool = False
    print_pdb: bool = False
    print_fasta: bool = False
    exit_fasta: bool = False
    print_sim: bool = False
    print_div: bool = False
    print_cv: bool = False
    id: bool = False
    ali_ss: bool = False
    ss_mult: bool = True


_KEYS = {"ALI": "seq", "PDBLIST": "pdblist", "NAME": "name", "FUN_SIM": "func", "PDBDIR": "pdbdir", "PDBEXT": "pdbext", "NORM": "norm", "OUTGROUP": "outgroup", "SHIFT_MAX": "shift_max", "SS_MULT": "ss_mult", "ALI_SS": "ali_ss", "PRINT_SIM": "print_sim", "PRINT_DIV": "print_div", "PRINT_CV": "print_cv", "PRINT_PDB": "print_pdb"}
_ALIASES = {"out": "name", "sim_thr": "seq_thr", "pbdir": "pdbdir"}
_IGNORED = {"ali_tm", "ali_co"}


def _typed(name: str, value: str | bool):
    kind = type(getattr(Config, name, None))
    if kind is bool:
        return value if isinstance(value, bool) else value not in ("0", "", "false")
    if kind in (int, float):
        return kind(value)
    return value.lower() if name == "norm" else value


def from_parameters(pairs: dict[str, str], base: Config = Config()) -> tuple[Config, list[str]]:  # noqa: B008
    """A configuration with KEY=value pairs applied, and warnings about keys that mean nothing."""
    known = {_KEYS[k]: _typed(_KEYS[k], v) for k, v in pairs.items() if k in _KEYS}
    return replace(base, **known), [f"unknown parameter {k}" for k in pairs if k not in _KEYS and not k.startswith("ALI_")]


def from_arguments(arguments: list[str], base: Config = Config()) -> tuple[Config, list[str]]:  # noqa: B008
    """A configuration with command-line flags applied, the last of equal ones; unknown flags give a warning.

    At least one of -ali, -seq and -pdblist is needed; -seq after -ali is ignored."""
    names, values, warnings, k = {f.name for f in fields(Config)}, {}, [], 0
    while k < len(arguments):
        flag = arguments[k].lstrip("-")
        name = _ALIASES.get(flag, flag)
        k += 1
        if name in _IGNORED:
            continue
        if name not in names or not arguments[k - 1].startswith("-"):
            warnings.append(f"unknown argument {arguments[k - 1]}")
        elif isinstance(getattr(Config, name, None), bool):
            values[name] = True
        elif k == len(arguments):
            warnings.append(f"no value for {flag}")
        else:
            if name == "seq" and "ali" in values:
                warnings.append("-seq is ignored after -ali")
            else:
                values[name] = _typed(name, arguments[k])
            k += 1
    config = replace(base, **values)
    if not (config.ali or config.seq or config.pdblist):
        raise ValueError("one of -ali, -seq and -pdblist is needed")
    if config.seq_thr > 1 or config.shift_max < 0:
        raise ValueError("seq_thr is at most 1 and shift_max at least 0")
    return config, warnings
