"""Schemas that recordings bring with them: types of fields, their codecs and shapes, serializers, and names of field paths.

A schema is small (limits bound it) and is made where a recording is decoded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from millrace.functions import wire
from millrace.functions.paths import pack, unpack
from millrace.limits import FormatError, Limits

#: Fixed values of the format: type names by what they are.
VECTORS = ("CNetworkUtlVectorBase", "CUtlVectorEmbeddedNetworkVar", "CUtlVector")
SIGNED = ("int8", "int16", "int32", "int64")
FLOATS = ("float32", "CNetworkedQuantizedFloat", "GameTime_t")
TEXTS = ("CUtlSymbolLarge", "CUtlString", "CGlobalSymbol")
COMPONENTS = (
    "CBodyComponentBaseAnimating", "CBodyComponentBaseAnimatingOverlay", "CBodyComponentBaseModelEntity", "CBodyComponent", "CBodyComponentSkeletonInstance",
    "CBodyComponentPoint", "CLightComponent", "CRenderComponent", "C_BodyComponentBaseAnimating", "C_BodyComponentBaseAnimatingOverlay", "CPhysicsComponent",
)
TIMES = ("m_flSimulationTime", "m_flAnimTime")
DEFAULT_LENGTH = 64


@dataclass(frozen=True)
class Profile:
    """What differs between games."""

    char_is_text: bool = True
    centred_angles: bool = True
    pitch_yaw: bool = False
    ammo: str | None = None
    lengths: dict[str, int] = field(default_factory=dict)
    pointers: frozenset[str] = frozenset()
    tables: frozenset[str] = frozenset()


@dataclass(frozen=True)
class TypeName:
    """A parsed type: pointer, array (of a length or a symbol), or generic."""

    base: str
    pointer: bool = False
    inner: TypeName | None = None
    length: int | None = None
    symbol: str | None = None


def parse_type(text: str) -> TypeName:
    text = text.strip()
    if text.endswith("*"):
        return TypeName(text[:-1].strip(), pointer=True)
    if "[" in text and text.endswith("]"):
        base, _, length = text[:-1].partition("[")
        length = length.strip()
        return TypeName(base.strip(), length=int(length)) if length.isascii() and length.isdigit() else TypeName(base.strip(), symbol=length)
    if "<" in text and ">" in text[text.index("<") :]:
        base, _, rest = text.partition("<")
        return TypeName(base.strip(), inner=parse_type(rest[: rest.rindex(">")]))
    return TypeName(text)


@dataclass(frozen=True)
class FieldSpec:
    """A field as its recording describes it; the numbers are places in the list of symbols."""

    type_sym: int | None = None
    name_sym: int | None = None
    bits: int | None = None
    low: float | None = None
    high: float | None = None
    flags: int | None = None
    serializer_sym: int | None = None
    node_sym: int | None = None
    encoder_sym: int | None = None
    polymorphic: bool = False


@dataclass(frozen=True)
class Hints:
    """What picks a codec besides the type."""

    name: str = ""
    bits: int | None = None
    low: float | None = None
    high: float | None = None
    flags: int | None = None
    encoder: str | None = None
    nested: bool = False


@dataclass(frozen=True)
class Shape:
    """A codec, and how the field is laid out: plain, pointer, fixed (of a length), vector (of elements with a codec) or table (of serializers)."""

    codec: wire.Codec
    kind: str = "plain"
    length: int | None = None
    element: wire.Codec | None = None


def float_codec(h: Hints) -> wire.Codec:
    if h.name in TIMES:
        return wire.simulation_time
    if h.encoder in ("coord", "normal"):
        return wire.COORD if h.encoder == "coord" else wire.NORMAL
    if (h.bits or 0) not in (0, 32):
        try:
            return wire.Quantized(h.bits, h.flags or 0, h.low or 0.0, h.high or 0.0)
        except FormatError:
            pass  # such numbers come in full
    return wire.FLOAT


def angle_codec(h: Hints, profile: Profile) -> wire.Codec:
    bits = h.bits or 0
    if h.encoder == "qangle_pitch_yaw" and profile.pitch_yaw:
        return wire.angles(bits, 2)
    if h.encoder == "qangle_precise":
        return wire.precise_angles(profile.centred_angles)
    return wire.angles(bits) if bits else wire.ANGLE_COORDS


def vector_codec(h: Hints, n: int) -> wire.Codec:
    return wire.NORMALS if n == 3 and h.encoder == "normal" else wire.several(f"vector{n}", n, float_codec(h))


_BY_NAME = {
    **dict.fromkeys(SIGNED, lambda h, p: Shape(wire.I64)), "bool": lambda h, p: Shape(wire.BOOL), **dict.fromkeys(FLOATS, lambda h, p: Shape(float_codec(h))),
    **dict.fromkeys(COMPONENTS, lambda h, p: Shape(wire.BOOL, "pointer")), **dict.fromkeys(TEXTS, lambda h, p: Shape(wire.TEXT)),
    "char": lambda h, p: Shape(wire.TEXT if p.char_is_text else wire.U64), "CUtlBinaryBlock": lambda h, p: Shape(wire.BLOB),
    "Quaternion": lambda h, p: Shape(wire.several("floats", 4, float_codec(h))), "CTransform": lambda h, p: Shape(wire.several("floats", 6, float_codec(h))),
    "QAngle": lambda h, p: Shape(angle_codec(h, p)), **dict.fromkeys(("Vector", "VectorWS"), lambda h, p: Shape(vector_codec(h, 3))),
    "Vector2D": lambda h, p: Shape(vector_codec(h, 2)), "Vector4D": lambda h, p: Shape(vector_codec(h, 4)),
}


def shape_of(type_text: str, hints: Hints, profile: Profile) -> Shape:
    """The codec and layout of a field; the first rule that fits its type decides."""
    if profile.ammo is not None and hints.name == profile.ammo:
        return Shape(wire.AMMO)
    t = parse_type(type_text)
    if t.pointer:
        return Shape(wire.BOOL, "pointer")
    if t.length is not None or t.symbol is not None:
        if t.base == "char":
            return Shape(wire.TEXT)
        length = t.length if t.length is not None else profile.lengths.get(t.symbol, DEFAULT_LENGTH)
        return Shape(shape_of(t.base, hints, profile).codec, "fixed", length)
    if t.inner is not None:
        if t.base not in VECTORS:
            return shape_of(t.base, hints, profile)
        if hints.nested:
            return Shape(wire.U64, "table")
        inside = type_text[type_text.index("<") + 1 : type_text.rindex(">")]
        return Shape(wire.U64, "vector", element=shape_of(inside, hints, profile).codec)
    if t.base in profile.pointers:
        return Shape(wire.BOOL, "pointer")
    if t.base in _BY_NAME:
        return _BY_NAME[t.base](hints, profile)
    if t.base in profile.tables:
        return Shape(wire.U64, "table")
    return Shape(wire.FIXED64 if hints.encoder == "fixed64" else wire.U64)


@dataclass(frozen=True)
class Field:
    """A field: children are what the next number of a path chooses from; an array of any length has one for all its elements."""

    name: str
    node: str
    type: str
    shape: Shape
    children: Sequence[Field] | None = None

    @property
    def repeats(self) -> bool:
        return self.shape.kind in ("vector", "table")

    @property
    def parts(self) -> list[str]:
        return [*(self.node.split(".") if self.node else ()), self.name]

    def child(self, i: int) -> Field | None:
        """The field that the next number of a path names; itself where nothing is below it."""
        if self.children is None:
            return self
        at = 0 if self.repeats else i
        return self.children[at] if at < len(self.children) else None


_ELEMENT = Field("", "", "", Shape(wire.U64))


class Serializer:
    """Ordered fields of a class."""

    def __init__(self, name: str, fields: Sequence[Field]):
        self.name, self.fields = name, fields
        self._found: dict[tuple[int, ...], Field] = {}

    def at(self, path: tuple[int, ...]) -> Field:
        """The field of a path."""
        found = self._found.get(path)
        if found is None:
            found = self.fields[path[0]] if path[0] < len(self.fields) else None
            for i in path[1:]:
                found = found and found.child(i)
            if found is None:
                raise FormatError(f"path {path} is outside serializer {self.name!r} of {len(self.fields)} fields")
            self._found[path] = found
        return found

    def key(self, dotted: str) -> int | None:
        """The packed path of a dotted name; numbers choose elements of arrays. The first field that fits is taken."""
        path = _search(self.fields, dotted.split("."))
        return pack(tuple(i & 255 for i in path)) if path else None

    def name_of(self, key: int) -> str | None:
        """The dotted name of a packed path."""
        path = unpack(key)
        if path[0] >= len(self.fields):
            return None
        here = self.fields[path[0]]
        out = here.parts
        for i in path[1:]:
            if here.children is None:
                if here.repeats:
                    out.append(str(i))
                break
            below = here.child(i)
            if below is None:
                return None
            out += [str(i)] if here.repeats else below.parts
            here = below
        return ".".join(out)

    def child(self, i: int, j: int) -> Field | None:
        """Field j of what is nested in field i."""
        inside = self.fields[i].children if i < len(self.fields) else None
        return inside[j] if inside is not None and j < len(inside) else None


def _search(fields: Sequence[Field], parts: list[str]) -> list[int] | None:
    for i, f in enumerate(fields):
        own = [p for p in f.parts if p]
        if parts[: len(own)] != own or len(parts) < len(own):
            continue
        rest = parts[len(own) :]
        if not rest:
            return [i]
        if f.repeats:
            if not (rest[0].isascii() and rest[0].isdigit()) or not f.children:
                continue
            if len(rest) == 1:
                return [i, int(rest[0])]
            below = f.children[0].children and _search(f.children[0].children, rest[1:])
            if below:
                return [i, int(rest[0]), *below]
        elif f.children and (below := _search(f.children, rest)):
            return [i, *below]
    return None


class Schema(dict[str, Serializer]):
    """Serializers by name; of several with one name the last counts. A nested serializer has to be defined before it is used."""

    @classmethod
    def build(cls, symbols: Sequence[str], specs: Sequence[FieldSpec], definitions: Sequence[tuple[int, Sequence[int]]], profile: Profile = Profile(), limits: Limits = Limits()) -> Schema:
        for what, n in (("symbols", len(symbols)), ("fields", len(specs)), ("serializers", len(definitions)), ("fields", sum(len(f) for _, f in definitions))):
            limits.need(what, n)

        def text(sym: int | None) -> str | None:
            if sym is None:
                return None
            if not 0 <= sym < len(symbols):
                raise FormatError(f"symbol {sym} of {len(symbols)}")
            return symbols[sym]

        for spec in specs:
            for sym in (spec.type_sym, spec.name_sym, spec.serializer_sym, spec.node_sym, spec.encoder_sym):
                text(sym)
        out, made = cls(), {}
        for name_sym, places in definitions:
            fields = []
            for at in places:
                if at not in made:
                    if not 0 <= at < len(specs):
                        raise FormatError(f"field {at} of {len(specs)}")
                    made[at] = _field(specs[at], text, out, profile, limits)
                fields.append(made[at])
            name = text(name_sym) or ""
            out[name] = Serializer(name, fields)
        return out


def _field(spec: FieldSpec, text, known: Schema, profile: Profile, limits: Limits) -> Field:
    nested = text(spec.serializer_sym)
    hints = Hints(text(spec.name_sym) or "", spec.bits, spec.low, spec.high, spec.flags, text(spec.encoder_sym), nested is not None)
    type_text = text(spec.type_sym) or ""
    shape = shape_of(type_text, hints, profile)
    if spec.polymorphic:
        shape = replace(shape, codec=wire.POLY)
    inside = known[nested].fields if nested in known else None
    out = Field(hints.name, text(spec.node_sym) or "", type_text, shape, inside)
    if shape.kind == "fixed":
        limits.need("array", shape.length)
        return replace(out, children=[out] * shape.length)
    if shape.kind == "vector":
        return replace(out, children=[replace(_ELEMENT, shape=Shape(shape.element))])
    return replace(out, children=[replace(_ELEMENT, children=inside)]) if shape.kind == "table" else out


@dataclass(frozen=True)
class NetworkClass:
    id: int
    name: str
    table: str = ""


class Classes:
    """Network classes by number and by name; both are unique."""

    def __init__(self, entries: Sequence[NetworkClass], limits: Limits = Limits()):
        limits.need("classes", len(entries))
        self.entries, self.by_id, self.ids = list(entries), {}, {}
        for c in entries:
            if c.id < 0:
                raise FormatError(f"class {c.name!r} has the number {c.id}")
            limits.need("class_id", c.id)
            for what, seen in ((c.id, self.by_id), (c.name, self.ids)):
                if what in seen:
                    raise FormatError(f"two classes are called {what!r}")
            self.by_id[c.id], self.ids[c.name] = c, c.id
        self.bits = max(1, max(self.by_id, default=0).bit_length())

    def __len__(self) -> int:
        return len(self.entries)

    def get(self, number: int) -> NetworkClass:
        if number not in self.by_id:
            raise FormatError(f"there is no class {number}")
        return self.by_id[number]

    def name_of(self, number: int) -> str | None:
        return self.by_id[number].name if number in self.by_id else None

    def id_of(self, name: str) -> int | None:
        return self.ids.get(name)
