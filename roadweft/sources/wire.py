"""Protobuf messages of ground-truth traces: one table of fields serves reading, writing and the file descriptor."""

from __future__ import annotations

import struct

# The public message interface, as (number, name, type); * marks repeated fields. Enumerations are int32.
MESSAGES = {
    "InterfaceVersion": ((1, "version_major", "uint32"), (2, "version_minor", "uint32"), (3, "version_patch", "uint32")),
    "Timestamp": ((1, "seconds", "int64"), (2, "nanos", "uint32")),
    "Identifier": ((1, "value", "uint64"),),
    "Vector3d": ((1, "x", "double"), (2, "y", "double"), (3, "z", "double")),
    "Orientation3d": ((1, "roll", "double"), (2, "pitch", "double"), (3, "yaw", "double")),
    "Dimension3d": ((1, "length", "double"), (2, "width", "double"), (3, "height", "double")),
    "BaseStationary": ((1, "dimension", "Dimension3d"), (2, "position", "Vector3d"), (3, "orientation", "Orientation3d")),
    "BaseMoving": ((1, "dimension", "Dimension3d"), (2, "position", "Vector3d"), (3, "orientation", "Orientation3d"), (4, "velocity", "Vector3d"), (5, "acceleration", "Vector3d")),
    "VehicleClassification": ((1, "type", "int32"), (5, "role", "int32")),
    "MovingObject": ((1, "id", "Identifier"), (2, "base", "BaseMoving"), (3, "type", "int32"), (6, "vehicle_classification", "VehicleClassification")),
    "LightClassification": ((1, "color", "int32"), (2, "icon", "int32"), (3, "mode", "int32"), (4, "counter", "double")),
    "TrafficLight": ((1, "id", "Identifier"), (2, "base", "BaseStationary"), (3, "classification", "LightClassification")),
    "BoundaryPoint": ((1, "position", "Vector3d"),),
    "BoundaryClassification": ((1, "type", "int32"),),
    "LaneBoundary": ((1, "id", "Identifier"), (2, "boundary_line", "BoundaryPoint*"), (3, "classification", "BoundaryClassification")),
    "LanePairing": ((1, "antecessor_lane_id", "Identifier"), (2, "successor_lane_id", "Identifier")),
    "LaneClassification": (
        (1, "type", "int32"), (3, "centerline", "Vector3d*"), (4, "centerline_is_driving_direction", "bool"), (7, "lane_pairing", "LanePairing*"), (8, "right_lane_boundary_id", "Identifier*"),
        (9, "left_lane_boundary_id", "Identifier*"), (12, "subtype", "int32"),
    ),
    "Lane": ((1, "id", "Identifier"), (2, "classification", "LaneClassification")),
    "ProjFrameOffset": ((1, "position", "Vector3d"), (2, "yaw", "double")),
    "GroundTruth": (
        (1, "version", "InterfaceVersion"), (2, "timestamp", "Timestamp"), (3, "host_vehicle_id", "Identifier"), (5, "moving_object", "MovingObject*"), (7, "traffic_light", "TrafficLight*"),
        (9, "lane_boundary", "LaneBoundary*"), (10, "lane", "Lane*"), (14, "proj_string", "string"), (15, "map_reference", "string"), (20, "proj_frame_offset", "ProjFrameOffset"),
    ),
    "MapAsamOpenDrive": ((1, "map_reference", "string"), (2, "open_drive_xml_content", "string")),
}
#: Numbers of scalar types in a file descriptor.
SCALARS = {"double": 1, "int64": 3, "uint64": 4, "int32": 5, "bool": 8, "string": 9, "uint32": 13}

_FIELDS = {name: {n: (field, kind.rstrip("*"), kind.endswith("*")) for n, field, kind in fields} for name, fields in MESSAGES.items()}

_ZERO = {"string": "", "double": 0.0, "bool": False}
_EMPTY = {name: {f: _ZERO.get(kind, 0) if kind in SCALARS else None for f, kind, _ in fields.values()} for name, fields in _FIELDS.items()}
_LISTS = {name: [f for f, _, many in fields.values() if many] for name, fields in _FIELDS.items()}


def varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _fixed() -> tuple[bytes, int, int, struct.Struct]:
    """A BaseMoving with all its numbers: its bytes, the bits that are no numbers, their values, and how to unpack the numbers."""
    parts = [(field, [k for _, k, _ in MESSAGES[kind]]) for _, field, kind in MESSAGES["BaseMoving"]]
    made = [encode("BaseMoving", {f: dict.fromkeys(names, v) for f, names in parts}) for v in (0.0, struct.unpack("<d", b"\xff" * 8)[0])]
    low, high = (int.from_bytes(m, "little") for m in made)
    return made[0], (1 << 8 * len(made[0])) - 1 ^ low ^ high, low, struct.Struct("<" + "2xxdxdxd" * len(parts))


def _base_moving(data: bytes) -> dict | None:
    """The message where all its numbers are there in order, or None."""
    template, mask, want, numbers = BASE
    if len(data) != len(template) or int.from_bytes(data, "little") & mask != want:
        return None
    a, b, c, d, e, f, g, h, i, j, k, m, n, o, p = numbers.unpack(data)
    return {
        "dimension": {"length": a, "width": b, "height": c}, "position": {"x": d, "y": e, "z": f}, "orientation": {"roll": g, "pitch": h, "yaw": i},
        "velocity": {"x": j, "y": k, "z": m}, "acceleration": {"x": n, "y": o, "z": p},
    }


def decode(name: str, data: bytes) -> dict:
    """A message as a dict: absent scalars are 0 or "", absent messages None, repeated fields lists. Unknown fields are skipped."""
    if name == "BaseMoving" and (found := _base_moving(data)):
        return found
    fields = _FIELDS[name]
    out = _EMPTY[name].copy()
    for f in _LISTS[name]:
        out[f] = []
    at, end = 0, len(data)
    while at < end:
        key, at = (data[at], at + 1) if data[at] < 128 else read_varint(data, at)
        wire = key & 7
        if wire == 0:
            raw, at = (data[at], at + 1) if at < end and data[at] < 128 else read_varint(data, at)
        elif wire == 1:
            raw, at = data[at : at + 8], at + 8
        elif wire == 2:
            size, at = read_varint(data, at)
            raw, at = data[at : at + size], at + size
        elif wire == 5:
            raw, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire} in {name}")
        if at > end:
            raise ValueError(f"{name} is cut short")
        if key >> 3 not in fields:
            continue
        field, kind, many = fields[key >> 3]
        if kind == "double":
            value = struct.unpack("<d", raw)[0]
        elif kind == "string":
            value = raw.decode()
        elif kind == "bool":
            value = bool(raw)
        elif kind in ("int32", "int64"):
            value = raw - 2**64 if raw >= 2**63 else raw
        else:
            value = raw if kind in SCALARS else decode(kind, raw)
        if many:
            out[field].append(value)
        else:
            out[field] = value
    return out


def encode(name: str, message: dict) -> bytes:
    """The bytes of a dict; fields that are None or absent are left out."""
    out = []
    for n, field, kind in MESSAGES[name]:
        value = message.get(field)
        for v in (value or []) if kind.endswith("*") else [value]:
            if v is None:
                continue
            base = kind.rstrip("*")
            if base == "double":
                out += [varint(n << 3 | 1), struct.pack("<d", v)]
            elif base in SCALARS and base != "string":
                out += [varint(n << 3), varint(int(v))]
            else:
                body = v.encode() if base == "string" else encode(base, v)
                out += [varint(n << 3 | 2), varint(len(body)), body]
    return b"".join(out)


BASE = _fixed()


def descriptor() -> bytes:
    """A serialised FileDescriptorSet of MESSAGES in package osi3."""
    part = lambda n, body: varint(n << 3 | 2) + varint(len(body)) + body
    text = lambda n, s: part(n, s.encode())
    number = lambda n, v: varint(n << 3) + varint(v)
    file = text(1, "ground_truth.proto") + text(2, "osi3")
    for name, fields in MESSAGES.items():
        body = text(1, name)
        for n, field, kind in fields:
            base = kind.rstrip("*")
            what = number(5, SCALARS[base]) if base in SCALARS else number(5, 11) + text(6, f".osi3.{base}")
            body += part(2, text(1, field) + number(3, n) + number(4, 3 if kind.endswith("*") else 1) + what)
        file += part(4, body)
    return part(1, file)
