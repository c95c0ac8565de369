"""FITS images: a reader and writer of the simple form, blocks of 2880 bytes with cards of 80."""

from __future__ import annotations

import numpy as np

BLOCK, CARD = 2880, 80
#: Array types by BITPIX. Fixed values of the format.
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


class FitsError(ValueError):
    """A file that holds no usable frame."""


def card_value(text: str) -> object:
    """Value of a card's field: text in quotes, T or F, a number; None if empty, the text itself if none of these."""
    text = text.strip()
    if text.startswith("'"):
        out, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] != "'":
                    break
                i += 1
            out.append(text[i])
            i += 1
        return "".join(out).rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E")) if kind is float else kind(text)
        except ValueError:
            pass
    return text or None


def read_header(data: bytes, at: int) -> tuple[dict[str, object], int]:
    """Cards of the header at ``at`` and where its data begin."""
    header: dict[str, object] = {}
    while at + BLOCK <= len(data):
        block = data[at : at + BLOCK].decode("latin-1")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD]
            key = card[:8].strip()
            if key == "END":
                return header, at
            if card[8:10] == "= ":
                header.setdefault(key, card_value(card[10:]))
    raise FitsError("no end of header")


def units(data: bytes):
    """(header, array or None) of each header and data unit."""
    at = 0
    while at < len(data):
        header, at = read_header(data, at)
        if "SIMPLE" not in header and "XTENSION" not in header:
            raise FitsError("no FITS header")
        shape = [int(header[f"NAXIS{i}"]) for i in range(int(header.get("NAXIS", 0)), 0, -1)]
        kind = np.dtype(KINDS.get(header.get("BITPIX"), ">u1"))
        size = int(np.prod(shape)) * kind.itemsize if shape else 0
        array = None
        if shape and header.get("XTENSION", "IMAGE") == "IMAGE":
            if at + size > len(data):
                raise FitsError("data are cut off")
            array = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape).astype(kind.newbyteorder("="))
            scale, zero = header.get("BSCALE", 1), header.get("BZERO", 0)
            if (scale, zero) != (1, 0):
                array = (array * float(scale) + float(zero)).astype(np.float32)
        yield header, array
        at += -(-(size * int(header.get("GCOUNT", 1)) + int(header.get("PCOUNT", 0))) // BLOCK) * BLOCK


def number(header: dict, key: str) -> float | None:
    try:
        return None if header.get(key) is None else float(header[key])
    except (TypeError, ValueError):
        return None


def read_image(data: bytes) -> dict:
    """Fields of the first two-dimensional image; FitsError without one, without observation date or detector.

    date_obs is the header's date and time as text; sun_x and sun_y count from 1, as the header does.
    """
    try:
        header, array = next(((h, a) for h, a in units(data) if a is not None and a.ndim == 2), (None, None))
    except FitsError:
        raise
    except Exception as e:
        raise FitsError(f"unreadable: {e}") from e
    if array is None:
        raise FitsError("no two-dimensional image")
    said = lambda k: str(header.get(k) or "").strip()
    date_obs = said("DATE-OBS") and said("DATE-OBS") + (f"T{said('TIME-OBS')}" if said("TIME-OBS") else "")
    if not date_obs:
        raise FitsError("no observation time")
    if not said("DETECTOR"):
        raise FitsError("no detector")
    center = (number(header, "CRPIX1"), number(header, "CRPIX2"))
    center = center if None not in center else (None, None)
    return {
        "data": array, "height": array.shape[0], "width": array.shape[1], "dtype": array.dtype.str, "date_obs": date_obs,
        "telescope": said("TELESCOP"), "detector": said("DETECTOR"), "instrument": f"{said('INSTRUME') or 'LASCO'}/{said('DETECTOR').upper()}",
        "exposure_seconds": number(header, "EXPTIME"), "filter_name": said("FILTER") if "FILTER" in header else None, "polarizer": said("POLAR") if "POLAR" in header else None,
        "sun_x": center[0], "sun_y": center[1], "plate_scale_arcsec": number(header, "CDELT1"), "roll_deg": number(header, "CROTA2"),
        "binning_x": int(number(header, "LEBXSUM") or 1), "binning_y": int(number(header, "LEBYSUM") or 1), "header": {k: str(v) for k, v in header.items()},
    }


def facts(read, length: int) -> dict:
    """date_obs, width, height of the first two-dimensional image of a file of which only headers are read: ``read(at, size)`` gives its bytes.

    FitsError for what ``read_image`` would refuse: no such image, data that are cut off, no observation date or detector.
    """
    at = 0
    while at < length:
        head = b""
        while True:  # a header is read block by block up to its end card
            block = read(at + len(head), BLOCK)
            head += block
            if len(block) < BLOCK or any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
                break
        header, size = read_header(head, 0)
        if "SIMPLE" not in header and "XTENSION" not in header:
            raise FitsError("no FITS header")
        try:
            shape = [int(header[f"NAXIS{i}"]) for i in range(int(header.get("NAXIS", 0)), 0, -1)]
            n = int(np.prod(shape, dtype=object)) * np.dtype(KINDS.get(header.get("BITPIX"), ">u1")).itemsize if shape else 0
            more = -(-(n * int(header.get("GCOUNT", 1)) + int(header.get("PCOUNT", 0))) // BLOCK) * BLOCK
        except (KeyError, TypeError, ValueError) as e:
            raise FitsError(f"unreadable: {e}") from e
        at += size
        if shape and header.get("XTENSION", "IMAGE") == "IMAGE":
            if at + n > length:
                raise FitsError("data are cut off")
            if len(shape) == 2:
                said = lambda k: str(header.get(k) or "").strip()
                if not said("DATE-OBS"):
                    raise FitsError("no observation time")
                if not said("DETECTOR"):
                    raise FitsError("no detector")
                return {"date_obs": said("DATE-OBS") + (f"T{said('TIME-OBS')}" if said("TIME-OBS") else ""), "width": shape[1], "height": shape[0]}
        at += more
    raise FitsError("no two-dimensional image")


def dimensions(data: bytes) -> tuple[int | None, int | None]:
    """(width, height) of the first array of two or more dimensions; (None, None) if there is none or the file is bad."""
    try:
        shape = next(a.shape for _, a in units(data) if a is not None and a.ndim >= 2)
    except (StopIteration, FitsError, ValueError, KeyError, TypeError):
        return None, None
    return int(shape[-1]), int(shape[-2])


def write_image(array: np.ndarray, header: dict[str, object]) -> bytes:
    """A file of one image, for fixtures and exports."""
    kind = next(k for k, v in KINDS.items() if np.dtype(v) == array.dtype.newbyteorder(">"))
    fields = {"SIMPLE": True, "BITPIX": kind, "NAXIS": array.ndim} | {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(array.shape))} | header
    text = lambda v: ("T" if v else "F").rjust(20) if isinstance(v, bool) else "'" + str(v).replace("'", "''").ljust(8) + "'" if isinstance(v, str) else str(v).rjust(20)
    cards = "".join(f"{k:<8}= {text(v)}".ljust(CARD)[:CARD] for k, v in fields.items()) + "END".ljust(CARD)
    head = cards.ljust(-(-len(cards) // BLOCK) * BLOCK).encode("latin-1")
    body = array.astype(array.dtype.newbyteorder(">")).tobytes()
    return head + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
