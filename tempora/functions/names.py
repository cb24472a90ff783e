"""Qualified names, URIs and binary values.

A qualified name is a struct of its namespace's URI and its local part (the
prefix is kept, and never compared).  Prefixes are looked up in a map of those in
scope; the empty prefix is the default namespace.  Built-in expressions only;
nulls in give nulls out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import encode_for_uri as encode_for_uri

#: Fixed value: the namespace that ``xml`` stands for in every scope.
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"


def qname(uri: Column, lexical: Column) -> Column:
    """``QName``: a name from its URI and ``prefix:local``."""
    prefix = F.when(F.contains(lexical, F.lit(":")), F.substring_index(lexical, ":", 1)).otherwise("")
    return F.struct(uri.alias("uri"), prefix.alias("prefix"), F.substring_index(lexical, ":", -1).alias("local"))


def namespace_for(prefix: Column, scope: Column) -> Column:
    """``namespace-uri-for-prefix``: null for a prefix that isn't in scope."""
    return F.when(prefix == "xml", XML_NAMESPACE).otherwise(F.try_element_at(scope, prefix))


def resolve_qname(lexical: Column, scope: Column) -> Column:
    """``resolve-QName``: a name from ``prefix:local`` and the prefixes in scope."""
    prefix = F.when(F.contains(lexical, F.lit(":")), F.substring_index(lexical, ":", 1)).otherwise("")
    return qname(F.coalesce(namespace_for(prefix, scope), F.lit("")), lexical)


def in_scope_prefixes(scope: Column) -> Column:
    return F.array_sort(F.array_union(F.map_keys(scope), F.array(F.lit("xml"))))


def same_name(a: Column, b: Column) -> Column:
    """``QName-equal``: by URI and local part."""
    return (a["uri"] == b["uri"]) & (a["local"] == b["local"])


def has_language(tag: Column, wanted: Column) -> Column:
    """``lang``: the tag is the wanted one or a sub-tag of it, whatever the case."""
    return (F.lower(tag) == F.lower(wanted)) | F.lower(tag).startswith(F.concat(F.lower(wanted), F.lit("-")))


# --- URIs -------------------------------------------------------------------------------------


def escape_except(s: Column, kept: str) -> Column:
    """Percent-escapes of the UTF-8 bytes of all characters that aren't in the class ``kept``."""
    characters = F.filter(F.split(s, ""), lambda c: c != "")
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(characters, lambda c: F.when(c.rlike(f"^[{kept}]$"), c).otherwise(escaped(c))), "")


def iri_to_uri(s: Column) -> Column:
    """What a URI can't hold: all but printable ASCII without ``<>"{}|\\^`` and the grave accent."""
    return escape_except(s, "!#-;=?-\\[\\]_a-z~")


def escape_html_uri(s: Column) -> Column:
    """All but printable ASCII and the space."""
    return escape_except(s, " -~")


def resolve_uri(relative: Column, base: Column) -> Column:
    """A reference against a base URI with an authority (RFC 3986), dot segments removed."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    own, rest = F.regexp_extract(relative, "^([^?#]*)", 1), F.regexp_extract(relative, "^[^?#]*(.*)$", 1)
    joined = F.when(own.startswith("/"), own).when(own == "", path).otherwise(F.concat(folder, own))
    # segments, where each '..' takes the one before away
    kept = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    closing = F.when(joined.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    absolute = F.concat(root, F.array_join(kept, "/"), closing, rest)
    return F.when(relative.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), relative).when(relative.startswith("//"), F.concat(F.substring_index(root, "//", 1), relative)).otherwise(absolute)


# --- binary values ----------------------------------------------------------------------------


def hex_equal(a: Column, b: Column) -> Column:
    """``hexBinary-equal``: octets, whatever the digits' case."""
    return F.try_to_binary(a, F.lit("hex")) == F.try_to_binary(b, F.lit("hex"))


def base64_equal(a: Column, b: Column) -> Column:
    """``base64Binary-equal``: octets, white space aside."""
    bare = lambda x: F.regexp_replace(x, "\\s+", "")
    return F.try_to_binary(bare(a), F.lit("base64")) == F.try_to_binary(bare(b), F.lit("base64"))
