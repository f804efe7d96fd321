"""Text and value normalisers as Column functions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """No-break spaces and runs of white space become single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\u00a0]+", " "))


def slug(c: Column, unicode: bool = False) -> Column:
    """Lower case, everything but letters and digits to '-'. ASCII unless unicode is asked for."""
    other = "[^\\p{L}\\p{N}]+" if unicode else "[^a-z0-9]+"
    return F.regexp_replace(F.regexp_replace(F.lower(c), other, "-"), "^-+|-+$", "")


def _trimmed_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[.)\\],;:]+$", ""), "(?i)\\.(Source|Sourcedata)$", "")


def extract_urls(*texts: Column) -> Column:
    """URLs, EMPIAR accessions and DOIs of the texts as canonical URLs, first occurrences in order."""
    text = F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts])
    text = F.replace(F.regexp_replace(text, "(?<=\\w)\\s*\\.\\s*(?=\\w)", "."), F.lit("w ww."), F.lit("www."))
    empiar = F.transform(F.regexp_extract_all(text, F.lit("(?i)(EMPIAR-\\d+)"), 1), lambda m: F.concat(F.lit("https://www.ebi.ac.uk/empiar/"), F.upper(m), F.lit("/")))
    doi = F.filter(F.regexp_extract_all(text, F.lit("(?i)(10\\.\\d{4,9}/[-._;()/:A-Z0-9]+)"), 1), lambda m: ~F.contains(F.upper(m), F.lit("EMPIAR-")))

    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit("(https?://[^\\s)\\];,]+)"), 1), _trimmed_url), empiar, F.transform(doi, lambda m: F.concat(F.lit("https://doi.org/"), _trimmed_url(m)))
    )
    return F.array_distinct(F.transform(found, lambda u: _trimmed_url(F.replace(u, F.lit(" "), F.lit("")))))


#: Part of a URL, repository.
REPOSITORIES = (
    ("empiar", "EMPIAR"),
    ("biostudies|bioimages", "BioStudies"),
    ("figshare", "figshare"),
    ("zenodo", "Zenodo"),
    ("webknossos", "webKnossos"),
    ("mpi-cbg\\.de", "MPI-CBG Cloud"),
    ("betaseg\\.github\\.io", "BetaSeg"),
    ("github\\.com/mobie", "GitHub/MoBIE"),
)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Value of the first pattern found in the lower-cased text."""
    out, low = None, F.lower(text)
    for pattern, value in rules:
        hit = F.rlike(low, F.lit(pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def repository_type(url: Column) -> Column:
    """X4 for one URL: a known repository, else its host, else 'other'."""
    return first_match(url, REPOSITORIES, F.when(F.contains(url, F.lit("://")), F.get(F.split(url, "/"), F.lit(2))).otherwise(F.lit("other")))


def repository_types(urls: Column) -> Column:
    return F.array_distinct(F.transform(urls, repository_type))


def first_int(c: Column) -> Column:
    """The first run of digits after removing commas."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), "\\d+", 0), F.lit("")).try_cast("bigint")



def size_range(raw: Column, files: Column) -> Column:
    """struct(lo, hi, note) in bytes (decimal units) from a size text and a file-count text."""
    units = F.create_map(*[F.lit(x) for kv in (("KB", 1e3), ("MB", 1e6), ("GB", 1e9), ("TB", 1e12)) for x in kv])
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), ",", "")
    bare = F.rlike(text, F.lit("^\\d+(\\.\\d+)?$"))
    each = "(?i)([0-9]*\\.?[0-9]+)\\s*-\\s*([0-9]*\\.?[0-9]+)\\s*(KB|MB|GB|TB)"
    n = F.when(F.coalesce(first_int(files), F.lit(0)) == 0, F.lit(1)).otherwise(first_int(files))
    ranged = F.contains(F.lower(text), F.lit("each")) & F.rlike(text, F.lit(each))
    part = lambda i: F.regexp_extract(text, each, i)
    scale = F.element_at(units, F.upper(part(3))) * n
    one = "(?i)([0-9]*\\.?[0-9]+)\\s*(KB|MB|GB|TB)"
    sizes = F.zip_with(
        F.regexp_extract_all(text, F.lit(one), 1), F.regexp_extract_all(text, F.lit(one), 2), lambda a, b: a.try_cast("double") * F.element_at(units, F.upper(b))
    )
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, x: acc + x)
    whole = lambda c: F.floor(c).cast("bigint")
    pair = lambda lo, hi, note: F.struct(whole(lo).alias("lo"), whole(hi).alias("hi"), note.alias("note"))
    none = F.lit(None).cast("double")
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", pair(none, none, F.lit("")))
        .when(bare, pair(text.try_cast("double") * 1e9, text.try_cast("double") * 1e9, F.lit("numeric cell without units in workbook; interpreted as GB from context")))
        .when(ranged, pair(part(1).try_cast("double") * scale, part(2).try_cast("double") * scale, F.concat(F.lit("range multiplied by reported file count ("), n.cast("string"), F.lit(")"))))
        .when(F.size(sizes) > 0, pair(total, total, F.lit("")))
        .otherwise(pair(none, none, F.lit("unable to parse size")))
    )


def mean_numeric(c: Column) -> Column:
    """Mean of all unsigned decimals in the text, null without any."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(\\d+(?:\\.\\d+)?)"), 1), lambda x: x.try_cast("double"))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def species(cell_type: Column, organism: Column) -> Column:
    """Text before a comma; a binomial or abbreviated binomial; else the organism type."""
    words = F.split(F.trim(cell_type), "\\s+")
    two = F.size(words) == 2
    binomial = two & F.rlike(F.get(words, F.lit(0)), F.lit("^\\p{Lu}")) & F.rlike(F.get(words, F.lit(1)), F.lit("^\\p{Ll}"))
    short = two & F.endswith(F.get(words, F.lit(0)), F.lit("."))
    return (
        F.when(F.contains(cell_type, F.lit(",")), F.trim(F.substring_index(cell_type, ",", 1)))
        .when(binomial | short, F.trim(cell_type))
        .otherwise(F.coalesce(F.nullif(F.trim(F.coalesce(organism, F.lit(""))), F.lit("")), F.trim(cell_type)))
    )


#: Tokens of each modality family, in the order of the tests.
MODALITY_FAMILIES = (
    ("fib-sem|sbf-sem|sem|electron|cryo|tem|et", "EM"),
    ("sxt|x-ray|stxm|hxt", "X-ray"),
    ("optical|fluorescence|phase contrast|diffraction|lls|sim", "optical"),
)


def modality_family(c: Column) -> Column:
    """X9."""
    return first_match(c, MODALITY_FAMILIES, F.lit("other"))


def split_terms(*values: Column) -> Column:
    """Terms between semicolons and commas, unquoted, lower case, first occurrences in order."""
    parts = F.split(F.concat_ws(";", *values), "[;,]")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', "")))), lambda x: x != ""))


def pairs(terms: Column) -> Column:
    """X11: all 2-combinations of the sorted distinct terms, joined by ':'."""
    return pairs_in_order(F.array_sort(F.array_distinct(terms)))


def pairs_in_order(a: Column) -> Column:
    """X11 on terms that are sorted and distinct already."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.greatest(F.size(a), F.lit(1))), lambda y: F.concat(x, F.lit(":"), y))))


#: Tokens of each metric family, in the order of the tests.
METRIC_FAMILIES = (
    ("volume fraction", "volume_fraction"),
    ("surface area", "surface_area"),
    ("contact|association", "contacts"),
    ("position|distance", "distance"),
    ("dimension", "dimensions"),
    ("shape", "shape"),
    ("density", "density"),
    ("count|#", "count"),
    ("volume", "volume"),
)


def metric_families(c: Column) -> Column:
    """X12."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: first_match(x, METRIC_FAMILIES, F.lit("other"))))


#: Tokens of each comparator class, in the order of the tests.
COMPARATORS = (
    ("cell cycle", "cell cycle"),
    ("glucose|metabolic|fed|fasted", "metabolic condition"),
    ("development|stage|differentiation|young|mature", "developmental stage"),
    ("methodology|resolution|modality", "methodology"),
    ("species|cell type", "cell type"),
    ("stress|infection|treatment|mutant|mutation", "treatment"),
)


def comparator_class(c: Column) -> Column:
    """Null when blank."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", first_match(c, COMPARATORS, F.lit("other")))


def sample_size_bucket(n: Column) -> Column:
    """X14."""
    return F.when(n.isNull(), "unknown").when(n <= 1, "1").when(n <= 10, "2-10").when(n <= 50, "11-50").otherwise("51+")


def completeness(organelles: Column, metrics: Column, sample_size: Column, xy: Column, z: Column, status: Column) -> Column:
    """Weighted share of the fields that are known, at most 1, two decimals."""
    part = lambda known, yes, no: F.when(known, yes).otherwise(no)
    score = (
        F.lit(0.35)
        + part(xy.isNotNull() | z.isNotNull(), 0.15, 0.05)
        + part(F.size(organelles) > 0, 0.2, 0.0)
        + part(F.size(metrics) > 0, 0.1, 0.0)
        + part(sample_size.isNotNull(), 0.1, 0.0)
        + part(status != "none", 0.1, 0.05)
    )
    return F.round(F.least(score, F.lit(1.0)), 2)


def isotropic(xy: Column, z: Column) -> Column:
    """Within 15 %; null when unknown."""
    top = F.greatest(xy, z)
    return F.when(xy.isNotNull() & z.isNotNull() & (top > 0), F.abs(xy - z) / top <= 0.15)


def public_status(has_asset: Column, note: Column) -> Column:
    """X17."""
    return F.when(~has_asset, "none").when(F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("full dataset provided")), "complete").otherwise("partial")


def notes(status: Column, sample_note: Column) -> Column:
    """Optional parts joined by spaces; null when none."""
    short = F.trim(F.coalesce(sample_note, F.lit("")))
    return F.nullif(
        F.concat_ws(
            " ",
            F.when(status == "complete", "Public data available.").when(status == "partial", "Some public data available."),
            F.when((short != "") & (F.length(short) <= 120), short),
        ),
        F.lit(""),
    )


def publication_url(pmid: Column, fallback: Column) -> Column:
    """X19."""
    return F.when(F.coalesce(pmid, F.lit("")) != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise(fallback)


#: Compound suffixes that count as one extension, longest first.
COMPOUND = (".ome.tiff", ".ome.tif", ".ome.zarr", ".nii.gz", ".xml.gz", ".tar.gz", ".json.gz", ".csv.gz", ".zarray", ".zattrs", ".zgroup")


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; compound suffixes whole; '' without any."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = None
    for suffix in COMPOUND:
        hit = F.endswith(name, F.lit(suffix))
        out = F.when(hit, suffix) if out is None else out.when(hit, suffix)
    return out.otherwise(F.regexp_extract(name, "(?<=[^.])(\\.[^.]+)$", 1))


def is_hidden(path: Column) -> Column:
    """Any part of the path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))


def mode_octal(mode: Column) -> Column:
    """The permission bits of a file mode in octal, with 0o before them."""
    return F.concat(F.lit("0o"), F.lower(F.conv(mode.bitwiseAND(0o7777).cast("string"), 10, 8)))


def iso_time(seconds: Column) -> Column:
    """ISO 8601 of seconds since 1970 in UTC, with microseconds where there are any."""
    micros = F.round(seconds.cast("double") * 1_000_000).cast("bigint")
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


#: Nanometres in a unit.
NANOMETRES = {
    **dict.fromkeys(("nm", "nanometer", "nanometers", "nanometre", "nanometres"), 1.0),
    **dict.fromkeys(("um", "µm", "μm", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres"), 1000.0),
    **dict.fromkeys(("angstrom", "angstroms", "ångström", "ångströms", "å", "a"), 0.1),
    **dict.fromkeys(("m", "meter", "meters", "metre", "metres"), 1e9),
    "mm": 1e6, "cm": 1e7, "inch": 2.54e7,
}


def unit_nm(unit: Column) -> Column:
    """Nanometres per unit, null for unknown units."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NANOMETRES.items() for x in kv]), F.lower(F.trim(unit)))


def scale_from_text(text: Column) -> Column:
    """struct(x, y, z) in nm from 'N nm isotropic' or 'A x B x C nm'; nm3 and nm^3 count as nm; null otherwise."""
    plain = F.replace(F.replace(F.replace(text, F.lit("×"), F.lit("x")), F.lit("nm3"), F.lit("nm")), F.lit("nm^3"), F.lit("nm"))
    three = "(?i)(\\d+(?:\\.\\d+)?)\\s*(?:nm)?\\s*x\\s*(\\d+(?:\\.\\d+)?)\\s*(?:nm)?\\s*x\\s*(\\d+(?:\\.\\d+)?)\\s*nm"
    same = "(?i)(\\d+(?:\\.\\d+)?)\\s*nm\\s*isotropic"
    num = lambda p, i: F.regexp_extract(plain, p, i).try_cast("double")
    triple = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    return F.when(F.rlike(plain, F.lit(same)), triple(num(same, 1), num(same, 1), num(same, 1))).when(F.rlike(plain, F.lit(three)), triple(num(three, 1), num(three, 2), num(three, 3)))


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal; plain bytes below 1 KiB."""
    out = F.when(n.isNull(), "unknown").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), start=1):
        value = F.format_string(f"%.1f {unit}", n / F.lit(float(1024**i)))
        out = out.when(n < 1024 ** (i + 1), value) if i < 4 else out.otherwise(value)
    return out


def slice_indices(depth: int, count: int) -> list[int]:
    """`count` evenly spaced planes with the first and last, refilled from 0 after rounding."""
    if depth <= 0 or count <= 0:
        return []
    if count >= depth:
        return list(range(depth))
    if count == 1:
        return [depth // 2]
    out = list(dict.fromkeys(round(i * (depth - 1) / (count - 1)) for i in range(count)))
    out += [i for i in range(depth) if i not in set(out)][: count - len(out)]
    return sorted(out)


def escape_formula(c: Column) -> Column:
    """Texts that a spreadsheet would run get a leading apostrophe."""
    return F.when(F.rlike(c, F.lit("^[=+\\-@\\t\\r]")), F.concat(F.lit("'"), c)).otherwise(c)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of the newline-joined parts."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, length)


def distance_um(dx: Column, dy: Column, dz: Column, x_nm: Column, y_nm: Column, z_nm: Column) -> Column:
    """X39."""
    return F.sqrt(F.pow(dx * x_nm, F.lit(2)) + F.pow(dy * y_nm, F.lit(2)) + F.pow(dz * z_nm, F.lit(2))) / 1000


def author_key(source: Column) -> Column:
    """First word of the name without 'et al'."""
    return F.lower(F.get(F.split(F.trim(F.regexp_replace(source, "(?i)\\s*et\\s+al\\.?.*$", "")), "\\s+"), F.lit(0)))


def identity(c: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def normal_path(c: Column) -> Column:
    """Forward slashes, no repeats, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\\\\", "/"), "/+", "/"), "^/|/$", "")


def citation_label(study: Column, dataset_id: Column, year: Column, source: Column) -> Column:
    """X42: 'Name et al., year, source'; the name is the first word of the study without years and 'et al', or of the id in title case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(study, F.lit("")), "\\b(19|20)\\d{2}\\b", ""), "(?i)\\bet\\s+al\\.?", "")
    author = F.nullif(F.regexp_extract(F.regexp_replace(bare, "[,\\s]+$", ""), "^\\s*(\\S+)", 1), F.lit(""))
    head = F.coalesce(F.nullif(F.substring_index(dataset_id, "-", 1), F.lit("")), dataset_id)
    words = F.filter(F.split(head, "[_\\s]+"), lambda w: w != "")
    named = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    return F.concat(F.coalesce(author, named), F.lit(" et al., "), year.cast("string"), F.lit(", "), source)


def public_data_label(status: Column) -> Column:
    """X42."""
    return F.concat(F.lit("Data Publicly Available: "), F.when(status == "complete", "Complete").when(status == "partial", "Partial").otherwise("None indexed"))


def voxel_size_label(xy: Column, z: Column, same: Column) -> Column:
    """Numbers without a trailing '.0'."""
    plain = lambda c: F.regexp_replace(c.cast("string"), "\\.0$", "")
    three = F.concat(plain(xy), F.lit(" x "), plain(z), F.lit(" nm voxel size (XY/Z, 3D)"), F.when(F.coalesce(same, F.lit(False)), " isotropic").otherwise(""))
    return F.when(xy.isNull(), "Unknown").when(z.isNull(), F.concat(plain(xy), F.lit(" nm voxel size (XY)"))).otherwise(three)
