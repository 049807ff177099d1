"""SOP classes by kind. The identifiers are fixed values of the DICOM standard."""

from __future__ import annotations

_ROOT = "1.2.840.10008.5.1.4.1.1."
RTSTRUCT = _ROOT + "481.3"
SPECTROSCOPY = _ROOT + "4.2"
MESH = [_ROOT + x for x in ("66.5", "68.1")]
SLIDE = _ROOT + "77.1.6"
PDF, STL = _ROOT + "104.1", _ROOT + "104.3"
VIDEO = [_ROOT + x for x in ("77.1.1.1", "77.1.4.1")]
PRESENTATION = {
    _ROOT + "11.1": "grayscale presentation state",
    _ROOT + "11.2": "color presentation state",
    _ROOT + "11.3": "pseudo-color presentation state",
    _ROOT + "11.4": "blending presentation state",
    _ROOT + "11.5": "xa/xrf presentation state",
    _ROOT + "11.8": "advanced blending presentation state",
}
REPORT = [_ROOT + f"88.{n}" for n in (11, 22, 33, 34, 35, 40, 50, 59, 65, 67, 68, 69, 70, 71, 72, 73, 74, 75)]
ULTRASOUND = [_ROOT + x for x in ("6.1", "6", "3.1", "3")]
NUCLEAR = _ROOT + "20"
PROJECTION = [_ROOT + x for x in ("77.1.5.1", "77.1.5.2", "1", "1.1", "1.1.1", "1.2", "1.2.1", "1.3", "1.3.1", "12.1", "12.2")]
PET = [_ROOT + x for x in ("128", "130")]

KINDS = (
    {RTSTRUCT: "rtstruct", SPECTROSCOPY: "spectroscopy", SLIDE: "slide", PDF: "pdf", STL: "stl"}
    | dict.fromkeys(MESH, "mesh")
    | dict.fromkeys(VIDEO, "video")
    | PRESENTATION
    | dict.fromkeys(REPORT, "report")
)
IMAGE_KINDS = dict.fromkeys(ULTRASOUND, "ultrasound") | {NUCLEAR: "nuclear"} | dict.fromkeys(PROJECTION, "projection")
SERIES_IMAGES = [RTSTRUCT, SPECTROSCOPY, *MESH]
SERIES_SOFTCOPIES = [_ROOT + "11.1", *REPORT]

#: Names of what reports and catalogues refer to most; fixed values of the standard. ``uid_name`` takes any longer table.
NAMES = {
    "1.2.840.10008.1.1": "Verification SOP Class", "1.2.840.10008.1.2": "Implicit VR Little Endian", "1.2.840.10008.1.2.1": "Explicit VR Little Endian", "1.2.840.10008.1.2.1.99": "Deflated Explicit VR Little Endian",
    "1.2.840.10008.1.2.2": "Explicit VR Big Endian", "1.2.840.10008.1.2.4.50": "JPEG Baseline (Process 1)", "1.2.840.10008.1.2.4.70": "JPEG Lossless, Non-Hierarchical, First-Order Prediction (Process 14 [Selection Value 1])",
    "1.2.840.10008.1.2.4.90": "JPEG 2000 Image Compression (Lossless Only)", "1.2.840.10008.1.2.4.91": "JPEG 2000 Image Compression", "1.2.840.10008.1.2.5": "RLE Lossless", "1.2.840.10008.1.3.10": "Media Storage Directory Storage",
    _ROOT + "1": "Computed Radiography Image Storage", _ROOT + "2": "CT Image Storage", _ROOT + "2.1": "Enhanced CT Image Storage", _ROOT + "3.1": "Ultrasound Multi-frame Image Storage", _ROOT + "4": "MR Image Storage",
    _ROOT + "4.1": "Enhanced MR Image Storage", _ROOT + "4.2": "MR Spectroscopy Storage", _ROOT + "6.1": "Ultrasound Image Storage", _ROOT + "7": "Secondary Capture Image Storage", _ROOT + "11.1": "Grayscale Softcopy Presentation State Storage",
    _ROOT + "11.2": "Color Softcopy Presentation State Storage", _ROOT + "20": "Nuclear Medicine Image Storage", _ROOT + "66.4": "Segmentation Storage", _ROOT + "88.11": "Basic Text SR Storage", _ROOT + "88.22": "Enhanced SR Storage",
    _ROOT + "88.33": "Comprehensive SR Storage", _ROOT + "88.59": "Key Object Selection Document Storage", _ROOT + "104.1": "Encapsulated PDF Storage", _ROOT + "128": "Positron Emission Tomography Image Storage",
    _ROOT + "130": "Enhanced PET Image Storage", _ROOT + "481.1": "RT Image Storage", _ROOT + "481.2": "RT Dose Storage", _ROOT + "481.3": "RT Structure Set Storage", _ROOT + "481.5": "RT Plan Storage",
}
