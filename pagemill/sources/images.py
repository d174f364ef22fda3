"""Image columns: sizes to fit, compression, preparation for OCR, by optional libraries (Pillow, OpenCV)."""

from __future__ import annotations

import importlib.util
import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRESETS = {"speed": ("contrast",), "balanced": ("deskew", "denoise", "contrast"), "quality": ("deskew", "denoise", "contrast", "borders")}


def fitted(width: Column, height: Column, most_width: int = 1600, most_height: int = 2400) -> Column:
    """struct(width, height) within bounds, in proportion; never larger than it was."""
    ratio = F.least(F.lit(1.0), F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    return F.struct(F.greatest(F.lit(1), F.floor(width * ratio)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * ratio)).cast("int").alias("height"))


def compression_ratio(before: Column, after: Column) -> Column:
    return F.coalesce(F.try_divide(F.octet_length(after).cast("double"), F.octet_length(before).cast("double")), F.lit(1.0))


def optimized(kind: str = "webp", quality: int = 85, most: tuple[int, int] = (1600, 2400)):
    """A function of an image column; an image that cannot be read stays as it is."""
    if importlib.util.find_spec("PIL") is None:
        raise RuntimeError("changing images needs Pillow, which is not installed")

    @F.pandas_udf("binary")
    def f(images: pd.Series) -> pd.Series:
        from PIL import Image

        def one(raw: bytes | None) -> bytes | None:
            try:
                im = Image.open(io.BytesIO(raw))
                im = im.convert("RGB") if kind == "jpeg" and im.mode in ("RGBA", "P") else im
                im.thumbnail(most, Image.LANCZOS)
                im.save(out := io.BytesIO(), kind.upper(), quality=quality)
                return out.getvalue()
            except Exception:  # the image as it was is the defined result
                return raw

        return images.map(one)

    return f


def prepared(mode: str = "balanced"):
    """A function of an image column that prepares scans for OCR by a preset's steps."""
    steps = PRESETS[mode]
    if importlib.util.find_spec("cv2") is None:
        raise RuntimeError("preparing scans needs OpenCV, which is not installed")

    @F.pandas_udf("binary")
    def f(images: pd.Series) -> pd.Series:
        import cv2
        import numpy as np

        def one(raw: bytes | None) -> bytes | None:
            im = None if raw is None else cv2.imdecode(np.frombuffer(raw, np.uint8), cv2.IMREAD_COLOR)
            if im is None:
                return raw
            if "deskew" in steps:
                found = cv2.HoughLines(cv2.Canny(cv2.cvtColor(im, cv2.COLOR_BGR2GRAY), 50, 150), 1, np.pi / 180, 200)
                turn = 0.0 if found is None else float(np.median([np.degrees(x[0][1]) - 90 for x in found]))
                if 0.5 <= abs(turn) <= 45:
                    h, w = im.shape[:2]
                    im = cv2.warpAffine(im, cv2.getRotationMatrix2D((w / 2, h / 2), turn, 1.0), (w, h), borderMode=cv2.BORDER_REPLICATE)
            if "denoise" in steps:
                im = cv2.fastNlMeansDenoisingColored(im)
            if "contrast" in steps:
                lab = cv2.cvtColor(im, cv2.COLOR_BGR2LAB)
                lab[:, :, 0] = cv2.createCLAHE(2.0, (8, 8)).apply(lab[:, :, 0])
                im = cv2.cvtColor(lab, cv2.COLOR_LAB2BGR)
            if "borders" in steps:
                x, y, w, h = cv2.boundingRect(cv2.findNonZero(cv2.threshold(cv2.cvtColor(im, cv2.COLOR_BGR2GRAY), 250, 255, cv2.THRESH_BINARY_INV)[1]))
                im = im[y : y + h, x : x + w] if w and h else im
            return cv2.imencode(".png", im)[1].tobytes()

        return images.map(one)

    return f
