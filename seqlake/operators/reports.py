"""Text and JSON reports from one-row results and findings."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats, validate

#: Keys of a protein report by residue, in its order; fixed values.
RESIDUES = {
    "A": "a_alanine", "R": "r_arginine", "N": "n_asparagine", "D": "d_aspartate", "C": "c_cysteine", "E": "e_glutamate", "Q": "q_glutamine", "G": "g_glycine",
    "H": "h_histidine", "I": "i_isoleucine", "L": "l_leucine", "K": "k_lysine", "M": "m_methionine", "F": "f_phenylalanine", "P": "p_proline", "S": "s_serine",
    "T": "t_threonine", "W": "w_tryptophan", "Y": "y_tyrosine", "V": "v_valine", "B": "b_asx", "Z": "z_glx", "J": "j_xle", "X": "x_unknown",
    "U": "u_selenocysteine", "O": "o_pyrrolysine",
}
#: Categories of findings in the order of a report; fixed values.
CATEGORIES = {
    "structure": ("fasta.no_records", "fasta.content_before_header", "fasta.header_control_byte", "fasta.sequence_control_byte", "fasta.empty_record"),
    "identifiers": ("fasta.empty_identifier", "fasta.duplicate_identifier", "fasta.identifier_too_long", "fasta.long_header", "header.convention_mismatch"),
    "alphabet": ("sequence.invalid_symbol",),
    "format": (
        "format.sequence_whitespace", "format.blank_sequence_line", "format.inconsistent_wrapping", "format.leading_bom", "format.missing_terminal_newline",
        "format.mixed_line_endings",
    ),
}
#: What a rule's occurrences count; fixed values.
UNITS = {
    "file": ("fasta.no_records", "format.leading_bom", "format.missing_terminal_newline", "format.mixed_line_endings"),
    "line": ("fasta.content_before_header", "format.sequence_whitespace", "format.blank_sequence_line"),
    "byte": ("fasta.header_control_byte", "fasta.sequence_control_byte", "sequence.invalid_symbol"),
}
#: Categories of failures: those of single codes, and of all others by their first word; fixed values.
FAILURES = {
    "source_stability": ("input.changed",),
    "index_compatibility": ("index.initial_header_required", "index.no_indexable_records", "index.identifier_too_long", "index.sequence_line_too_long", "index.record_count_limit_exceeded", "index.nonuniform_fai"),
    "index_match": ("index.source_size_mismatch", "index.source_mtime_mismatch", "index.older_than_source"),
}
PREFIXES = {
    "usage": "usage", "io": "io", "resource": "resources", "input": "structure", "index": "index_integrity", "pair": "index_match", "request": "requests",
    "transform": "transforms", "repair": "repair", "internal": "internal",
}
#: What a text report says of a code; fixed values.
MESSAGES = {
    "fasta.no_records": "No FASTA records were found.", "fasta.content_before_header": "Content appears before the first FASTA header.",
    "fasta.header_control_byte": "Header contains a prohibited control byte.", "fasta.sequence_control_byte": "Sequence contains a prohibited control byte.",
    "fasta.empty_record": "FASTA record contains no sequence symbols.", "fasta.empty_identifier": "Header has an empty identifier.",
    "fasta.duplicate_identifier": "Identifier duplicates an earlier record.", "fasta.identifier_too_long": "Identifier is longer than an index can hold.",
    "fasta.long_header": "Header exceeds the selected length limit.", "header.convention_mismatch": "Header does not match the selected convention.",
    "sequence.invalid_symbol": "Sequence byte is outside the selected alphabet.", "format.sequence_whitespace": "Sequence line contains whitespace.",
    "format.blank_sequence_line": "Blank line occurs inside a FASTA record.", "format.inconsistent_wrapping": "Sequence line width differs from the record's wrap width.",
    "format.leading_bom": "File starts with a UTF-8 BOM.", "format.missing_terminal_newline": "Nonempty file has no terminal newline.",
    "format.mixed_line_endings": "File mixes LF and CRLF line endings.",
}
#: Numbers of a first finding in the order of a report; fixed values.
FACTS = ("byte", "content_bytes", "whitespace_bytes", "observed_bytes", "limit_bytes", "expected_width", "actual_width")
PREVIEW, SHOWN = 256, 32


def _share(n: int, total: int) -> str:
    share = (n * 20000 + total) // (total * 2) if total else 0
    return f"{n} {share // 100}.{share % 100:02d}%"


def stats_text(lengths, composition, residues: dict | None = None, path: str = "", extension: str = "", size: int = 0) -> str:
    """The report of ``stats.length_summary`` and ``stats.composition`` rows; of protein with ``residues`` (``stats.protein_counts``)."""
    stats.check_total(lengths["total"], composition["total"])
    total = composition["total"]
    out = ["File:", f"  path: {path}", f"  index: {path}{extension}", f"  size_bytes: {size}", "", "Lengths:"]
    out += [f"  indexed_records: {lengths['records']}", f"  total_symbols: {lengths['total']}"]
    out += [f"  {key}: {lengths[k]}" for key, k in (("shortest_length", "shortest"), ("shortest_name", "shortest_name"), ("longest_length", "longest"), ("longest_name", "longest_name"))]
    out += [*(f"  {k}: {lengths[k]}" for k in ("mean", "q1", "median", "q3", "range")), "", "Nx:", *(f"  {k}: {lengths[k]}" for k in ("n50", "l50", "n90", "l90", "aun"))]
    out += ["", "Composition:", f"  type: {composition['type']}", "  percent_denominator: total_symbols"]
    if composition["type"] == "protein" and residues is not None:
        out += [f"  {key}: {_share(residues[r], total)}" for r, key in RESIDUES.items()]
        out += [f"  {key}: {_share(residues[key], total)}" for key in ("stop", "invalid")]
    else:
        out += [f"  {'iupac_ambiguous' if k == 'ambiguous' else k}: {_share(composition[k], total)}" for k in ("a", "c", "g", "t", "u", "n", "ambiguous", "invalid")]
        out += [f"  gc: {composition['gc']}" + "%" * (composition["gc"] != "n/a"), f"  gc_skew: {composition['gc_skew']}"]
    return "\n".join([*out, f"  lowercase: {_share(composition['lowercase'], total)}"]) + "\n"


def validation(lines: DataFrame, strict: bool = False, alphabet: str = "auto", schema: str | None = None, long_header: int = validate.LONG_HEADER, name_budget: int | None = None, index: dict | None = None) -> dict:
    """The report of a data set's lines: outcome, policy, checks, examined, findings, categories, codes, invalid symbols.

    Findings are summed by file and code, and then by code, before anything reaches the driver; a check's state and the
    outcome follow from its errors and warnings. Each code has its first finding, of the first file by name. The alphabet 'auto' is
    chosen file by file; the policy names that of the first files' sample.
    With ``name_budget`` the report is incomplete if a file's ids pass it. ``index``: format, entries,
    matched and omitted_duplicates of a comparison (``validate.compared``).
    """
    name, sample = validate.sampled(lines) if alphabet == "auto" else (alphabet, None)
    selection = "automatic" if alphabet == "auto" else "explicit" if alphabet in (*validate.ALPHABETS, "any") else "custom"
    found = validate.findings(lines, alphabet, schema, long_header, name_budget)
    by_file, order = validate.places(found, lines), list(validate.RULES)
    first = F.min_by(F.struct("offset", "line", "column", "record", "identifier", "identifier_bytes", "related", "data"), "file")
    sums = {r["code"]: r for r in by_file.groupBy("code").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), first.alias("first")).collect()}
    rows = [{"code": c, "severity": validate.RULES[c], **{k: sums[c][k] for k in ("occurrences", "records", "first")}} for c in order if c in sums]
    stop = validate.names_stopped(lines, name_budget).orderBy("file").first() if name_budget is not None else None
    total = lambda some, s: sum(r["occurrences"] for r in some if r["severity"] == s)
    state = lambda some: "failed" if total(some, "error") else "warnings" if total(some, "warning") else "passed"
    by = {k: [r for r in rows if r["code"] in codes] for k, codes in CATEGORIES.items()}
    unit = {code: u for u, codes in UNITS.items() for code in codes}
    touched = validate.records_by_severity(found).first().asDict()
    checks = {k: state(some) for k, some in by.items()} | ({"identifiers": "incomplete"} if stop else {})

    def place(row):
        f = row["first"]
        facts = {k: f["data"][k] for k in FACTS if k in (f["data"] or {})}
        facts |= {"grammar": "controls_except_tab"} if "control" in row["code"] else {"convention": schema} if row["code"] == "header.convention_mismatch" else {}
        shown = None if f["identifier"] is None else opaque(f["identifier"].encode("iso-8859-1"), original=f["identifier_bytes"])
        return {"offset": f["offset"], "line": f["line"], "column": f["column"], "record": f["record"], "identifier": shown, "related": f["related"].asDict() if f["related"] else None, "data": facts}

    return {
        "outcome": "incomplete" if stop else "invalid" if total(rows, "error") else "warnings" if total(rows, "warning") else "clean",
        "completion": "incomplete" if stop else "complete",
        "policy": {"strict": strict, "alphabet": {"alphabet": name if selection != "custom" else "custom", "selection": selection, "sample": None if sample is None else {"symbols": sample, "rule": "nucleotide_above_90_percent"}}, "max_header_bytes": long_header, "header_convention": schema},
        "checks": checks,
        "examined": validate.examined(lines).first().asDict(),
        "findings": {"errors": total(rows, "error"), "warnings": total(rows, "warning"), "error_codes": sum(r["severity"] == "error" for r in rows), "warning_codes": sum(r["severity"] == "warning" for r in rows)},
        "categories": {k: {"errors": total(some, "error"), "warnings": total(some, "warning")} for k, some in by.items()},
        "name_budget": {"budget_bytes": name_budget, "stopped_at_record": stop["stopped_at_record"]} if stop else None,
        "index": index,
        **touched,
        "codes": [{"code": r["code"], "category": category(r["code"]), "severity": r["severity"], "unit": unit.get(r["code"], "record"), "occurrences": r["occurrences"], "records": r["records"], "first": place(r)} for r in rows],
        "invalid_symbols": [{"byte": r["byte"], "occurrences": r["n"]} for r in validate.invalid_symbols(lines, alphabet).orderBy("byte").collect()],
    }


def exit_status(report: dict) -> int:
    """0 for a clean data set, 1 after errors (or warnings if strict), 2 after warnings."""
    return {"clean": 0, "invalid": 1, "incomplete": 1, "warnings": 1 if report["policy"]["strict"] else 2}[report["outcome"]]


def validation_json(report: dict) -> str:
    """JSON; counts are 64-bit numbers and so stand as strings, a byte is a number."""

    def safe(x, key=None):
        if isinstance(x, dict):
            return {k: safe(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [safe(v) for v in x]
        return str(x) if isinstance(x, int) and not isinstance(x, bool) and key != "byte" else x

    return json.dumps(safe(report), ensure_ascii=False)


def opaque(data: bytes, most: int = PREVIEW, original: int | None = None) -> dict:
    """Bytes that may be no text: the first ``most`` of them as UTF-8 if they are, or else in base64.

    ``original``: how many there are, where ``data`` has only the first.
    """
    head, size = data[:most], len(data) if original is None else original
    try:
        encoding, value = "utf8", head.decode()
    except UnicodeDecodeError:
        encoding, value = "base64", base64.b64encode(head).decode()
    return {"encoding": encoding, "value": value, "truncated": size > len(head), "original_bytes": str(size)}


def escaped(data: bytes) -> str:
    """Bytes as printable ASCII: quotes and backslashes behind a backslash, all else as \\xNN."""
    return "".join("\\" + chr(x) if x in b'"\\' else chr(x) if 32 <= x < 127 else f"\\x{x:02x}" for x in data)


def _count(n: int, noun: str) -> str:
    return f"{n} {noun}" + "s" * (n != 1)


def _at(place: dict) -> str:
    return f"line {place['line']} column {place['column']}"


def _finding(c: dict) -> str:
    out, first = f"{c['severity']} [{c['code']}]", c["first"]
    if c["unit"] != "file":
        out += " " + _count(c["occurrences"], c["unit"]) + (" in " + _count(c["records"], "record") if c["unit"] != "record" and c["records"] else "")
    if first["line"] is not None:
        out += (" at " if c["unit"] == "file" else "; first at ") + _at(first)
    if first["record"] is not None:
        out += f", record {first['record']}"
    if first["identifier"] is not None:
        shown = first["identifier"]
        data = (shown["value"].encode() if shown["encoding"] == "utf8" else base64.b64decode(shown["value"]))[:SHOWN]
        out += f' "{escaped(data)}"' + (f" ({shown['original_bytes']} bytes)" if len(data) != int(shown["original_bytes"]) else "")
    out += f": {MESSAGES[c['code']]}"
    out += "".join(f" {k}=0x{v:02x}" if k == "byte" else f" {k}={v}" for k, v in first["data"].items())
    return out + (f" First defined at {_at(first['related'])}." if first["related"] else "")


def validation_text(report: dict, path: str = "input") -> str:
    """The report as text: its outcome and totals, a line a code with its first place, and what was examined."""
    found, seen, sample = report["findings"], report["examined"], report["policy"]["alphabet"]["sample"]
    head = f"{ {'clean': 'OK'}.get(report['outcome'], report['outcome'].upper()) } {escaped(path.encode())}: "
    if found["errors"] + found["warnings"]:
        errors, warnings = (_count(found[f"{k}s"], k) + " in " + _count(found[f"{k}_codes"], "code") for k in ("error", "warning"))
        head += f"{errors}, {warnings}; {report['records_with_errors']} of {_count(seen['records'], 'record')} with errors, {report['records_with_warnings']} with warnings"
    else:
        head += "no findings"
    last = f"{report['completion']}: examined " + ", ".join(_count(seen[f"{k}s"], k) for k in ("byte", "line", "record"))
    if seen["records_completed"] != seen["records"]:
        last += f" ({seen['records_completed']} completed)"
    last += f", {_count(seen['symbols'], 'symbol')}; {report['policy']['alphabet']['alphabet']} alphabet" + (f" chosen from {_count(sample['symbols'], 'symbol')}" if sample else "")
    if stop := report["name_budget"]:
        last += f"; duplicate check stopped at record {stop['stopped_at_record']} at its {stop['budget_bytes']}-byte name budget"
    if index := report["index"]:
        last += f"; {index['format']} index: {index['matched']} of {index['entries']} entr{'y' if index['entries'] == 1 else 'ies'} matched"
        last += f", {_count(index['omitted_duplicates'], 'later duplicate')} not indexed" if index["omitted_duplicates"] else ""
    return "\n".join([head, *map(_finding, report["codes"]), last]) + "\n"


def category(code: str) -> str:
    """The category of a code, of a finding or a failure."""
    for name, codes in CATEGORIES.items():
        if code in codes:
            return name
    for name, codes in FAILURES.items():
        if code in codes:
            return name
    return PREFIXES[code.split(".")[0]]


def failure_json(code: str, message: str = "", **details) -> str:
    """A failure as JSON: its code, category, message and typed details."""
    return json.dumps({"code": code, "category": category(code), "message": message, "details": {k: opaque(v) if isinstance(v, bytes) else str(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in details.items()}}, ensure_ascii=False)
