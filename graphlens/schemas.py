"""Fixed values of the graph tables: kinds of nodes."""

# Kinds of nodes by what may be called, used as a type, or imported as a module.
CALLABLE_KINDS = ["function", "method", "test"]
TYPE_KINDS = ["class", "struct", "interface", "trait", "enum"]
MODULE_KINDS = ["module", "package", "namespace"]
#: Nodes without an API surface of their own, a module's own symbols, and what they hold.
STRUCTURAL_KINDS = ["file", "package", "module", "import", "export"]
TOPLEVEL_KINDS = ["class", "struct", "interface", "trait", "enum", "function", "test", "constant", "capability"]
MEMBER_KINDS = ["method", "property", "field", "test", "class"]
#: Order in which a qualified name's nodes are preferred, and the place of kinds that aren't listed.
KIND_ORDER = {
    "package": 0, "module": 1, "namespace": 2, "capability": 2, "convention": 2, "class": 3, "struct": 3, "interface": 3, "trait": 3, "enum": 3,
    "function": 4, "method": 4, "test": 4, "property": 5, "constant": 6, "field": 6, "type_alias": 6, "example": 9,
}
OTHER_ORDER = 7
