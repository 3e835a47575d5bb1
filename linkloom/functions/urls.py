"""URL functions on columns. Malformed input gives empty parts, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"^[^#]*#(.*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    """Host with port and user information, as written."""
    return F.regexp_extract(url, AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, FRAGMENT, 1)


def without_www(host: Column) -> Column:
    """A first label that begins with ``www`` goes if a dot follows."""
    return F.regexp_replace(host, r"^www[^.]*\.", "")


def normalized(url: Column) -> Column:
    """The key of a page: netloc without its www label, and path."""
    return F.concat(without_www(netloc(url)), path(url))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, ``/`` for an empty path; null without a host.

    Percent-encoding and international hosts are left as they are; `normal_form` settles them too."""
    host = F.regexp_replace(F.lower(netloc(url)), r":$", "")
    host = F.when(scheme(url) == "http", F.regexp_replace(host, r":80$", "")).when(scheme(url) == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1)
    return F.when((netloc(url) != "") & (scheme(url) != ""), F.concat(scheme(url), F.lit("://"), host, F.when(path(url) == "", "/").otherwise(path(url)), tail))


#: Characters that stand for themselves in a path, query or fragment, and escapes that stand for letters and the like.
PLAIN = r"^[A-Za-z0-9._~!$&'()*+,;=:@/?\[\]-]$"
NEEDLESS = r"^%(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$"


def percent_encoded(part: Column) -> Column:
    """A URL's part with every character escaped that has to be (as its UTF-8 bytes, a lone ``%`` too), none that
    needn't be, and escapes in upper case."""
    pieces = F.regexp_extract_all(part, F.lit("(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))

    def settled(x: Column) -> Column:
        escape = F.upper(x)
        char = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("long"))
        own = F.when(x.rlike(PLAIN), x).otherwise(F.regexp_replace(F.hex(x), "(..)", "%$1"))
        return F.when(F.length(x) == 3, F.when(escape.rlike(NEEDLESS), char).otherwise(escape)).otherwise(own)

    return F.array_join(F.transform(pieces, settled), "")


def ascii_host(host: Column) -> Column:
    """A host's international labels in their ASCII form (``xn--``); as it is if they have none."""
    made = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike("^[\\x00-\\x7F]*$"), host).otherwise(F.coalesce(made, host))


def normal_form(url: Column) -> Column:
    """The canonical URL with an ASCII host without a last dot, no dot segments, and settled percent-encoding in
    path, query and fragment; null without a host."""
    plain = canonical(url)
    host = F.regexp_replace(ascii_host(netloc(plain)), r"\.(?=:[0-9]+$|$)", "")
    tail = F.regexp_extract(plain, r"^[^?#]*([?#].*)$", 1)
    # The first "#" begins the fragment; later ones are escaped.
    marked = F.when(tail == "", "").otherwise(F.concat(F.when(F.startswith(tail, F.lit("?")), F.concat(F.lit("?"), percent_encoded(query(plain)))).otherwise(""), F.when(F.contains(tail, F.lit("#")), F.concat(F.lit("#"), percent_encoded(fragment(plain)))).otherwise("")))
    return F.concat(scheme(plain), F.lit("://"), host, without_dots(percent_encoded(path(plain))), marked)


def without_dots(url_path: Column) -> Column:
    """A path with ``.`` and ``..`` segments worked off; one at the end leaves its slash."""
    parts = F.split(F.regexp_replace(url_path, r"/(\.\.?)$", "/$1/"), "/")
    nothing = F.slice(parts, F.lit(1), F.lit(0))
    folded = F.aggregate(parts, nothing, lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(url_path.rlike(r"/\.\.?(/|$)"), F.array_join(folded, "/")).otherwise(url_path)


def resolved(base: Column, href: Column) -> Column:
    """A link's target as seen from its page; null for an empty or null reference."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    plain = lambda ref: F.concat(without_dots(F.regexp_extract(ref, r"^[^?#]*", 0)), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1))
    return (
        F.when(F.trim(href) == "", F.lit(None))
        .when(scheme(href) != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, plain(href)))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path(base), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(root, plain(F.concat(F.when(folder == "", "/").otherwise(folder), href))))
    )


def suffix_size(host: Column, suffixes: Sequence[str]) -> Column:
    """How many labels a host's public suffix has, given those of more than one label, such as co.uk."""
    known = F.array(*[F.lit(s) for s in suffixes]).cast("array<string>")
    last = lambda n: F.concat_ws(".", F.slice(F.reverse(F.slice(F.reverse(F.split(F.lower(host), r"\.")), F.lit(1), F.lit(n))), F.lit(1), F.lit(n)))
    return F.when(F.array_contains(known, last(3)), 3).when(F.array_contains(known, last(2)), 2).otherwise(1)


def generalized(host: Column, url_path: Column, suffix_labels: int | Column = 1) -> Column:
    """suffix/domain/subdomains from right to left (``S`` if none)/path parts, where decimal parts
    become ``#``, parts over ten characters ``A`` and others are lower-cased and trimmed.

    A public suffix is taken to be the last ``suffix_labels`` labels of the host; `suffix_size` gives
    their number by a list of suffixes."""
    suffix_labels = F.lit(suffix_labels) if isinstance(suffix_labels, int) else suffix_labels
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.array_join(F.slice(labels, F.greatest(n - suffix_labels + 1, F.lit(1)), suffix_labels), ".")
    domain = F.coalesce(F.get(labels, n - suffix_labels - 1), F.lit(""))
    inner = F.slice(labels, F.lit(1), F.greatest(n - suffix_labels - 1, F.lit(0)))
    subdomain = F.when(n > suffix_labels + 1, F.array_join(F.reverse(inner), "/")).otherwise(F.lit("S"))
    parts = F.filter(F.split(url_path, "/"), lambda p: p != "")
    shapes = F.transform(parts, lambda p: F.when(p.rlike(r"^\p{Nd}+$"), "#").when(F.length(p) <= 10, F.trim(F.lower(p))).otherwise("A"))
    return F.concat_ws("/", suffix, domain, subdomain, F.when(F.size(shapes) > 0, F.array_join(shapes, "/")))


def filename_safe(text: Column) -> Column:
    """Letters, digits and dots stay, all else becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}.]", "_")
