"""The numbers in packet headers, read for all packets of an Arrow batch at once.

Each field is a number at a place in every packet; places that depend on
earlier fields are arrays too. What the numbers mean as text is left to column
expressions.
"""

from __future__ import annotations

import numpy as np

#: What ``header_numbers`` finds, null where a packet has no such field. ``body`` is what TCP or UDP carries, without the
#: length before DNS over TCP.
FIELDS = (
    "at", "type", "tagged", "control", "layer", "proto", "carry", "fragment", "source", "target", "operation", "sport", "dport",
    "seq", "ack", "flags", "window", "body_at", "body_size", "icmp_type", "icmp_code", "dns_0", "dns_4",
)
IPV4, IPV6, ARP, OTHER_IP = 4, 6, 0, 1
RAW_LINKS = (101, 228, 229)
VLAN_TYPES = (0x8100, 0x88A8)


class Octets:
    """Values of an Arrow array of bytes; null has no bytes."""

    def __init__(self, values):
        import pyarrow as pa

        wide = pa.types.is_large_binary(values.type)
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        self.starts, self.sizes = ends[:-1], np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
        self.data = np.concatenate([np.frombuffer(data or b"", np.uint8), np.zeros(4, np.uint8)])

    def number(self, place, size: int, rows=slice(None)):
        """The big-endian number at a place of each value, -1 where the value ends before."""
        inside = (place >= 0) & (place + size <= self.sizes[rows])
        first = np.where(inside, self.starts[rows] + place, 0)
        total = np.zeros(len(first), np.int64)
        for i in range(size):
            total = total * 256 + self.data[first + i]
        return np.where(inside, total, -1)

    def cut(self, row: int, place: int, size: int) -> bytes:
        start = int(self.starts[row] + place)
        return self.data[start : start + size].tobytes()


def has_port(found: dict, *ports: int):
    return np.isin(found["sport"], ports) | np.isin(found["dport"], ports)


def header_numbers(octets: Octets, link) -> dict:
    """Arrays by field, -1 for null."""
    number, left_out = octets.number, -1
    only = lambda rows, values: np.where(rows, values, left_out)
    at = np.select([link == 1, link == 113], [14, 16], 0)
    # Tags stand one after the other in front of the type: two bytes of kind, two of control.
    tagged, rows = np.zeros(len(at), np.int64), np.flatnonzero(link == 1)
    while rows.size:
        place = tagged[rows] * 4 + 12
        more = np.isin(number(place, 2, rows), VLAN_TYPES) & (place + 6 <= octets.sizes[rows])
        rows = rows[more]
        tagged[rows] += 1
    at = at + tagged * 4
    found = {"at": at, "tagged": tagged, "control": only(tagged > 0, number(np.full(len(at), 14), 2))}
    kind = found["type"] = only(np.isin(link, (1, 113)), number(at - 2, 2))

    raw, nibble = np.isin(link, RAW_LINKS), number(np.zeros(len(at), np.int64), 1) // 16
    v4, v6 = (kind == 0x0800) | (raw & (nibble == 4)), (kind == 0x86DD) | (raw & (nibble == 6))
    arp = kind == 0x0806
    found["layer"] = np.select([v4, v6, arp, raw], [IPV4, IPV6, ARP, OTHER_IP], left_out)

    left = octets.sizes - at
    header = np.where(v4, number(at, 1) % 16 * 4, 40)
    v4, v6, arp = v4 & (left >= 20) & (header >= 20) & (left >= header), v6 & (left >= 40), arp & (left >= 28)
    declared = number(at + 2, 2)
    total = np.where(declared > 0, np.minimum(left, declared), left)
    size = np.where(v4, np.maximum(total - header, 0), np.minimum(left - 40, number(at + 4, 2)))
    proto = found["proto"] = np.select([v4, v6], [number(at + 9, 1), number(at + 6, 1)], left_out)
    found["carry"] = only(v4 | v6, size)
    found["fragment"] = only(v4, number(at + 6, 2))
    found["source"] = only(v4 | arp, number(at + np.where(arp, 14, 12), 4))
    found["target"] = only(v4 | arp, number(at + np.where(arp, 24, 16), 4))
    found["operation"] = only(arp, number(at + 6, 2))

    start = at + header
    tcp, udp = (proto == 6) & (size >= 20), (proto == 17) & (size >= 8)
    found["sport"], found["dport"] = only(tcp | udp, number(start, 2)), only(tcp | udp, number(start + 2, 2))
    found["seq"], found["ack"] = only(tcp, number(start + 4, 4)), only(tcp, number(start + 8, 4))
    found["flags"], found["window"] = only(tcp, number(start + 13, 1)), only(tcp, number(start + 14, 2))
    icmp = np.isin(proto, (1, 58)) & (size >= 2)
    found["icmp_type"], found["icmp_code"] = only(icmp, number(start, 1)), only(icmp, number(start + 1, 1))

    length = number(start + 4, 2)
    head = np.where(tcp, number(start + 12, 1) // 16 * 4, 8)
    body = np.maximum(np.where(udp & (length > 0), np.minimum(size, length), size) - head, 0)
    # DNS over TCP is preceded by its length.
    shift = np.where(tcp & has_port(found, 53) & (body >= 2), 2, 0)
    found["body_at"], found["body_size"] = only(tcp | udp, start + head + shift), only(tcp | udp, body - shift)
    dns = (udp & has_port(found, 5353) | (tcp | udp) & has_port(found, 53)) & (found["body_size"] >= 12)
    found["dns_0"], found["dns_4"] = only(dns, number(found["body_at"], 4)), only(dns, number(found["body_at"] + 4, 4))
    return found
