"""File formats by their first bytes, by text shape or by byte distribution."""

from __future__ import annotations

import numpy as np

from bytelens.functions import payload as pl

# Signature, place, format. RIFF and ftyp stand for what their brand at byte 8 says.
SIGNATURES = (
    (b"\x1f\x8b", 0, "Gzip"),
    (b"\x28\xb5\x2f\xfd", 0, "Zstd"),
    (b"\xfd7zXZ\x00", 0, "Xz"),
    (b"BZh", 0, "Bzip2"),
    (b"\x04\x22\x4d\x18", 0, "Lz4"),
    (b"\xff\xd8\xff", 0, "Jpeg"),
    (b"\x89PNG\r\n\x1a\n", 0, "Png"),
    (b"GIF87a", 0, "Gif"),
    (b"GIF89a", 0, "Gif"),
    (b"RIFF", 0, "RIFF"),
    (b"ftyp", 4, "ftyp"),
    (b"ID3", 0, "Mp3"),
    (b"\xff\xfb", 0, "Mp3"),
    (b"\xff\xfa", 0, "Mp3"),
    (b"\xff\xf3", 0, "Mp3"),
    (b"\xff\xf2", 0, "Mp3"),
    (b"OggS", 0, "Ogg"),
    (b"fLaC", 0, "Flac"),
    (b"PK\x03\x04", 0, "Zip"),
    (b"PK\x05\x06", 0, "Zip"),
    (b"ustar", 257, "Tar"),
    (b"7z\xbc\xaf\x27\x1c", 0, "SevenZ"),
    (b"PAR1", 0, "Parquet"),
    (b"ARROW1\x00\x00", 0, "ArrowIpc"),
    (b"FEA1", 0, "Feather"),
    (b"SQLite format 3\x00", 0, "Sqlite"),
    (b"%PDF-", 0, "Pdf"),
    (b"%!PS", 0, "PostScript"),
    (b"\x7fELF", 0, "Elf"),
    (b"\xfe\xed\xfa\xce", 0, "MachO32"),
    (b"\xce\xfa\xed\xfe", 0, "MachO32"),
    (b"\xfe\xed\xfa\xcf", 0, "MachO64"),
    (b"\xcf\xfa\xed\xfe", 0, "MachO64"),
    (b"MZ", 0, "Pe"),
    (b"\x00asm\x01\x00\x00\x00", 0, "Wasm"),
)
# MIME type, category and whether compression may pay, of each format.
FORMATS = {
    "Gzip": ("application/gzip", "bin", False),
    "Zstd": ("application/zstd", "bin", False),
    "Xz": ("application/x-xz", "bin", False),
    "Bzip2": ("application/x-bzip2", "bin", False),
    "Lz4": ("application/x-lz4", "bin", False),
    "Brotli": (None, "bin", False),
    "Jpeg": ("image/jpeg", "img", False),
    "Png": ("image/png", "img", False),
    "Gif": ("image/gif", "img", False),
    "Webp": ("image/webp", "img", False),
    "Heic": ("image/heic", "img", False),
    "Avif": ("image/avif", "img", False),
    "Mp3": ("audio/mpeg", "aud", False),
    "Mp4": ("video/mp4", "vid", False),
    "Wav": ("audio/wav", "aud", False),
    "Ogg": ("application/ogg", "aud", False),
    "Flac": ("audio/flac", "aud", False),
    "Zip": ("application/zip", "bin", False),
    "Tar": ("application/x-tar", "bin", False),
    "SevenZ": ("application/x-7z-compressed", "bin", False),
    "Parquet": ("application/vnd.apache.parquet", "bin", False),
    "ArrowIpc": ("application/vnd.apache.arrow.file", "bin", False),
    "Feather": ("application/vnd.apache.arrow.feather", "bin", False),
    "Sqlite": ("application/vnd.sqlite3", "bin", True),
    "Pdf": ("application/pdf", "bin", True),
    "PostScript": ("application/postscript", "bin", True),
    "Elf": ("application/x-elf", "bin", True),
    "MachO32": ("application/x-mach-binary", "bin", True),
    "MachO64": ("application/x-mach-binary", "bin", True),
    "Pe": ("application/vnd.microsoft.portable-executable", "bin", True),
    "Wasm": ("application/wasm", "bin", True),
    "Utf8Text": ("text/plain", "txt", True),
    "AsciiText": ("text/plain", "txt", True),
    "Json": ("application/json", "txt", True),
    "Xml": ("application/xml", "txt", True),
    "HighEntropy": (None, "unk", False),
    "Unknown": (None, "unk", True),
}
HEIC_BRANDS = (b"heic", b"heix", b"hevc", b"hevx", b"mif1", b"msf1")
AVIF_BRANDS = (b"avif", b"avis")
PROBE = 1024


def _branded(name: str, raw: bytes) -> str | None:
    brand = raw[8:12]
    if len(brand) < 4:
        return None
    if name == "RIFF":
        return {b"WEBP": "Webp", b"WAVE": "Wav"}.get(brand)
    return "Heic" if brand in HEIC_BRANDS else "Avif" if brand in AVIF_BRANDS else "Mp4"


def detect(raw: bytes) -> tuple[str, int, int, int]:
    """(format, offset, length, confidence). Of signatures that fit, the one that ends first decides."""
    for sign, at, name in sorted(SIGNATURES, key=lambda s: s[1] + len(s[0])):
        if raw[at : at + len(sign)] == sign:
            if name not in ("RIFF", "ftyp"):
                return name, at, len(sign), 100
            if found := _branded(name, raw):
                return found, 0, 12, 90
    text = _text(raw)
    if text:
        return text, 0, 0, 60
    if len(raw) >= 16:
        _, mean, var, skew, kurt = pl.moments(np.frombuffer(raw, np.uint8))
        if abs(mean - 127.5) < 12 and abs(var - 5461.25) / 5461.25 < 0.10 and abs(skew) < 0.20 and abs(kurt + 1.2) < 0.30:
            return "HighEntropy", 0, 0, 50
    return "Unknown", 0, 0, 0


def _text(raw: bytes) -> str | None:
    valid, good, _ = pl.utf8(raw)
    if not valid and good < min(len(raw), PROBE):
        return None
    probe = raw[: min(len(raw) if valid else good, PROBE)]
    first = probe.lstrip(b" \t\n\r")[:1]
    if not first or any(x < 32 and x not in b"\t\n\r" or x == 127 for x in set(probe)):
        return None
    return {b"{": "Json", b"[": "Json", b"<": "Xml"}.get(first) or ("AsciiText" if probe.isascii() else "Utf8Text")
