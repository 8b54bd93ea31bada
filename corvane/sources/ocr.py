"""Text of scanned PDFs by engines in a process of its own.

`ProcessOcr` finds a Python that has the engines, hands it a PDF on standard input and reads the text from its
standard output: a crash or a hang of an engine costs a file, not a Spark task. Run as a program, this
module is that process: text layer, then Tesseract, then PaddleOCR, each if it is installed.
"""

from __future__ import annotations

import shutil
import subprocess
import sys
from collections.abc import Callable, Sequence

# Limits in seconds, the length of a note, the engines' settings.
RUN_S, PROBE_S, NOTE = 300, 10, 300
DPI, LANGUAGES, PAGE_MODE = 150, "chi_sim+eng", 6
PROBE = "import fitz"

#: Statuses: Success, PdfNotFound, PythonNotFound, ScriptNotFound, PythonStartFailed, TimedOut, ProcessFailed, NoText.
NOTES = {
    "PdfNotFound": "there is no PDF",
    "PythonNotFound": "no Python with the PDF library (fitz) was found",
    "ScriptNotFound": "the OCR program is missing",
    "TimedOut": "OCR took too long; try fewer or clearer pages",
    "NoText": "no text was found in the PDF",
}


class ProcessOcr:
    """A provider for `files.parse`. pythons: interpreters to try, in order; script: the program to run in place of
    this module; probe: what an interpreter must be able to run."""

    def __init__(self, pythons: Sequence[str] = (), script: str | None = None, timeout: float = RUN_S, probe: str = PROBE, probe_timeout: float = PROBE_S):
        self.pythons = tuple(pythons) or tuple(dict.fromkeys(p for p in (sys.executable, shutil.which("python3"), shutil.which("python")) if p))
        self.script, self.timeout, self.probe, self.probe_timeout = script, timeout, probe, probe_timeout
        self.found: str | None = None

    def python(self) -> str | None:
        """The first interpreter that passes the probe; it is looked for once."""
        if self.found is None:
            self.found = next((p for p in self.pythons if self._passes(p)), "")
        return self.found or None

    def _passes(self, python: str) -> bool:
        try:
            return subprocess.run([python, "-c", self.probe], capture_output=True, timeout=self.probe_timeout).returncode == 0
        except (OSError, subprocess.TimeoutExpired):
            return False

    def read(self, pdf: bytes) -> tuple[str, str, str]:
        """(status, text, note)."""
        if not pdf:
            return self._failed("PdfNotFound")
        python = self.python()
        if python is None:
            return self._failed("PythonNotFound")
        script = self.script or __file__
        try:
            with open(script, "rb"):
                pass
        except OSError:
            return self._failed("ScriptNotFound")
        try:
            done = subprocess.run([python, script], input=pdf, capture_output=True, timeout=self.timeout)
        except subprocess.TimeoutExpired:
            return self._failed("TimedOut")
        except OSError as e:
            return "PythonStartFailed", "", f"OCR cannot be started: {e}"
        if done.returncode:
            note = done.stderr.decode("utf-8", "replace").strip()
            return "ProcessFailed", "", "OCR failed: " + (note[:NOTE] + "..." if len(note) > NOTE else note) if note else "OCR failed"
        text = done.stdout.decode("utf-8", "replace")
        return ("Success", text, "") if text.strip() else self._failed("NoText")

    @staticmethod
    def _failed(status: str) -> tuple[str, str, str]:
        return status, "", NOTES[status]


Pages = list[str | None]


def text_layer(pdf: bytes) -> Pages:
    import fitz

    with fitz.open(stream=pdf, filetype="pdf") as pages:
        return [_or_none(page.get_text) for page in pages]


def _images(pdf: bytes):
    """Each page as an RGB picture, None for one that cannot be drawn."""
    import fitz
    from PIL import Image

    def drawn(page):
        p = page.get_pixmap(dpi=DPI, alpha=False)
        return Image.frombytes("RGB", (p.width, p.height), p.samples)

    with fitz.open(stream=pdf, filetype="pdf") as pages:
        for page in pages:
            yield _or_none(drawn, page)


def tesseract(pdf: bytes) -> Pages:
    import pytesseract

    return [image and _or_none(pytesseract.image_to_string, image, lang=LANGUAGES, config=f"--psm {PAGE_MODE}") for image in _images(pdf)]


def paddle(pdf: bytes) -> Pages:
    import numpy
    from paddleocr import PaddleOCR

    engine = PaddleOCR(use_angle_cls=True, lang="ch", show_log=False)

    def page(image) -> str:
        found = engine.ocr(numpy.asarray(image), cls=True)
        return "\n".join(line[1][0] for part in found or () for line in part or ())

    return [image and _or_none(page, image) for image in _images(pdf)]


def _or_none(f: Callable, *args, **options):
    """A page that fails is left out; the others count."""
    try:
        return f(*args, **options)
    except Exception as e:
        print(f"page: {e}", file=sys.stderr)
        return None


def cascade(pdf: bytes, engines: Sequence[Callable[[bytes], Pages]] = (text_layer, tesseract, paddle)) -> tuple[str, list[str]]:
    """The text of the first engine that gives any, pages apart by blank lines, and notes of those that could not."""
    notes = []
    for engine in engines:
        try:
            text = "\n\n".join(p.strip() for p in engine(pdf) if p and p.strip())
        except Exception as e:  # it is not installed, or cannot read the file: the next one's turn
            notes.append(f"{engine.__name__}: {e}")
            continue
        if text:
            return text, notes
    return "", notes


def main() -> int:
    text, notes = cascade(sys.stdin.buffer.read())
    if not text and notes:
        print("; ".join(notes), file=sys.stderr)
        return 1
    sys.stdout.buffer.write(text.encode())
    return 0


if __name__ == "__main__":
    sys.exit(main())
