"""PNG images of the SVG that quantloom.plans.render writes: rectangles, lines, paths of M and L, circles, text, translated groups."""

from __future__ import annotations

import struct
import zlib
from xml.etree import ElementTree

import numpy as np

from quantloom.errors import FactorError

MAX_PIXELS, MAX_BYTES = 16_000_000, 64 << 20
#: Letters of three by five dots, a digit from 0 to 7 for each row. Small letters are drawn as capitals.
DOTS = {
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227",
    "J": "11152", "K": "55655", "L": "44447", "M": "57755", "N": "65555", "O": "25552", "P": "65644", "Q": "25563", "R": "65655",
    "S": "34216", "T": "72222", "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247",
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71122", "8": "75757", "9": "75717",
    ".": "00002", ",": "00024", "-": "00700", "—": "00700", "+": "02720", ":": "02020", "%": "51245", "(": "12221", ")": "42224",
    "/": "11244", "_": "00007", "=": "07070", "…": "00005", " ": "00000",
}
UNKNOWN = "77777"


class _Canvas:
    def __init__(self, width: int, height: int, scale: float) -> None:
        self.pixels = np.full((height, width, 3), 255, np.uint8)
        self.scale = scale

    def box(self, x: float, y: float, w: float, h: float, color: np.ndarray, opacity: float = 1.0) -> None:
        tall, wide = self.pixels.shape[:2]
        x0, y0 = (min(max(round(v * self.scale), 0), top) for v, top in ((x, wide), (y, tall)))
        x1, y1 = (min(max(round(v * self.scale), 0), top) for v, top in ((x + w, wide), (y + h, tall)))
        part = self.pixels[y0:y1, x0:x1]
        part[:] = np.rint(part * (1 - opacity) + color * opacity)

    def dots(self, xs: np.ndarray, ys: np.ndarray, color: np.ndarray) -> None:
        """Pixels at given places; those outside the image are left out."""
        tall, wide = self.pixels.shape[:2]
        inside = (xs >= 0) & (xs < wide) & (ys >= 0) & (ys < tall)
        self.pixels[ys[inside], xs[inside]] = color

    def stroke(self, a: tuple[float, float], b: tuple[float, float], color: np.ndarray, width: float = 1.0) -> None:
        (x0, y0), (x1, y1) = ((x * self.scale, y * self.scale) for x, y in (a, b))
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 2
        xs, ys = (np.rint(np.linspace(u, v, n)).astype(int) for u, v in ((x0, x1), (y0, y1)))
        for k in range(max(1, round(width * self.scale))):
            self.dots(*((xs + k, ys) if abs(y1 - y0) > abs(x1 - x0) else (xs, ys + k)), color)

    def disc(self, x: float, y: float, r: float, color: np.ndarray) -> None:
        cx, cy, r = round(x * self.scale), round(y * self.scale), max(1.0, r * self.scale)
        at = np.arange(-int(r), int(r) + 1)
        dx, dy = np.meshgrid(at, at)
        near = dx**2 + dy**2 <= r * r
        self.dots(cx + dx[near], cy + dy[near], color)

    def text(self, x: float, y: float, text: str, size: float, anchor: str, color: np.ndarray, bold: bool) -> None:
        dot = max(1, round(size * self.scale / 6))
        step = 3 * dot + max(1, dot // 2)
        left = round(x * self.scale) - {"middle": len(text) * step // 2, "end": len(text) * step}.get(anchor, 0)
        top = round(y * self.scale) - 5 * dot
        square = np.arange(dot)
        for i, c in enumerate(text):
            for row, bits in enumerate(DOTS.get(c.upper(), UNKNOWN)):
                for col in range(3):
                    if int(bits) >> (2 - col) & 1:
                        dx, dy = np.meshgrid(square, square)
                        across = (left + i * step + col * dot + dx).ravel()
                        down = (top + row * dot + dy).ravel()
                        self.dots(across, down, color)
                        if bold and dot > 1:
                            self.dots(across + 1, down, color)


def _color(text: str) -> np.ndarray:
    return np.array([int(text[k : k + 2], 16) for k in (1, 3, 5)], float)


def _draw(canvas: _Canvas, node: ElementTree.Element, dx: float, dy: float, size: float, full: tuple[float, float]) -> None:
    a, tag = node.attrib, node.tag.split("}")[-1]
    num = lambda k, default="0": float(a.get(k, default))
    size = num("font-size", str(size))
    if tag == "g" and "transform" in a:
        x, y = a["transform"].removeprefix("translate(").removesuffix(")").split(",")
        dx, dy = dx + float(x), dy + float(y)
    elif tag == "rect":
        w, h = (v if a[k] == "100%" else num(k) for k, v in zip(("width", "height"), full, strict=True))
        canvas.box(dx + num("x"), dy + num("y"), w, h, _color(a["fill"]), num("fill-opacity", "1"))
    elif tag == "line":
        canvas.stroke((dx + num("x1"), dy + num("y1")), (dx + num("x2"), dy + num("y2")), _color(a["stroke"]))
    elif tag == "circle":
        canvas.disc(dx + num("cx"), dy + num("cy"), num("r"), _color(a["fill"]))
    elif tag == "path":
        steps, last = a["d"].replace("M", " M ").replace("L", " L ").split(), None
        for pen, x, y in zip(steps[::3], steps[1::3], steps[2::3], strict=True):
            here = (dx + float(x), dy + float(y))
            # A lone point is a dot.
            canvas.stroke(last if pen == "L" else here, here, _color(a["stroke"]), num("stroke-width", "1"))
            last = here
    elif tag == "text":
        canvas.text(dx + num("x"), dy + num("y"), node.text or "", size, a.get("text-anchor", "start"), _color(a["fill"]), a.get("font-weight") == "bold")
    for child in node:
        if child.tag.split("}")[-1] != "title":
            _draw(canvas, child, dx, dy, size, full)


def png(svg: str) -> bytes:
    """The image of an SVG text. Raises where it would have over MAX_PIXELS pixels or MAX_BYTES bytes."""
    root = ElementTree.fromstring(svg)
    width, height = int(root.attrib["width"]), int(root.attrib["height"])
    if width * height > MAX_PIXELS:
        raise FactorError("the report has too many pixels for one image")
    view = [float(v) for v in root.attrib["viewBox"].split()[2:]]
    canvas = _Canvas(width, height, width / view[0])
    _draw(canvas, root, 0.0, 0.0, 11.0, (view[0], view[1]))
    lines = np.concatenate((np.zeros((height, 1), np.uint8), canvas.pixels.reshape(height, -1)), axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
    if len(out) > MAX_BYTES:
        raise FactorError("the image has too many bytes")
    return out
