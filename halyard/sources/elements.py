"""Data elements: what tags are called, and data sets as bytes, made of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.lut import bound

# fixed values: keywords of the registered data elements used here, with tag and value representation
ELEMENTS = {
    "FileMetaInformationVersion": ("00020001", "OB"),
    "MediaStorageSOPClassUID": ("00020002", "UI"),
    "MediaStorageSOPInstanceUID": ("00020003", "UI"),
    "TransferSyntaxUID": ("00020010", "UI"),
    "ImplementationClassUID": ("00020012", "UI"),
    "SpecificCharacterSet": ("00080005", "CS"),
    "ImageType": ("00080008", "CS"),
    "SOPClassUID": ("00080016", "UI"),
    "SOPInstanceUID": ("00080018", "UI"),
    "StudyDate": ("00080020", "DA"),
    "SeriesDate": ("00080021", "DA"),
    "AcquisitionDate": ("00080022", "DA"),
    "ContentDate": ("00080023", "DA"),
    "StudyTime": ("00080030", "TM"),
    "AcquisitionTime": ("00080032", "TM"),
    "AccessionNumber": ("00080050", "SH"),
    "Modality": ("00080060", "CS"),
    "Manufacturer": ("00080070", "LO"),
    "InstitutionName": ("00080080", "LO"),
    "ReferringPhysicianName": ("00080090", "PN"),
    "CodeValue": ("00080100", "SH"),
    "CodingSchemeDesignator": ("00080102", "SH"),
    "CodeMeaning": ("00080104", "LO"),
    "StationName": ("00081010", "SH"),
    "StudyDescription": ("00081030", "LO"),
    "SeriesDescription": ("0008103E", "LO"),
    "ReferencedSeriesSequence": ("00081115", "SQ"),
    "ReferencedImageSequence": ("00081140", "SQ"),
    "ReferencedSOPClassUID": ("00081150", "UI"),
    "ReferencedSOPInstanceUID": ("00081155", "UI"),
    "ReferencedFrameNumber": ("00081160", "IS"),
    "PatientName": ("00100010", "PN"),
    "PatientID": ("00100020", "LO"),
    "IssuerOfPatientID": ("00100021", "LO"),
    "PatientBirthDate": ("00100030", "DA"),
    "PatientSex": ("00100040", "CS"),
    "OtherPatientIDsSequence": ("00101002", "SQ"),
    "PatientAge": ("00101010", "AS"),
    "BodyPartExamined": ("00180015", "CS"),
    "SliceThickness": ("00180050", "DS"),
    "StudyInstanceUID": ("0020000D", "UI"),
    "SeriesInstanceUID": ("0020000E", "UI"),
    "StudyID": ("00200010", "SH"),
    "SeriesNumber": ("00200011", "IS"),
    "InstanceNumber": ("00200013", "IS"),
    "ImagePositionPatient": ("00200032", "DS"),
    "ImageOrientationPatient": ("00200037", "DS"),
    "FrameOfReferenceUID": ("00200052", "UI"),
    "Laterality": ("00200060", "CS"),
    "SamplesPerPixel": ("00280002", "US"),
    "PhotometricInterpretation": ("00280004", "CS"),
    "NumberOfFrames": ("00280008", "IS"),
    "Rows": ("00280010", "US"),
    "Columns": ("00280011", "US"),
    "PixelSpacing": ("00280030", "DS"),
    "BitsAllocated": ("00280100", "US"),
    "BitsStored": ("00280101", "US"),
    "HighBit": ("00280102", "US"),
    "PixelRepresentation": ("00280103", "US"),
    "PixelPaddingValue": ("00280120", "US"),
    "WindowCenter": ("00281050", "DS"),
    "WindowWidth": ("00281051", "DS"),
    "RescaleIntercept": ("00281052", "DS"),
    "RescaleSlope": ("00281053", "DS"),
    "ScheduledProcedureStepSequence": ("00400100", "SQ"),
    "ContentSequence": ("0040A730", "SQ"),
    "PixelData": ("7FE00010", "OW"),
}
# fixed values: representations whose length has four bytes, and transfer syntaxes that are not little endian with stated representations
LONG = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"


def tag_of(name: str) -> tuple[int, str | None]:
    """(tag, representation or None if unknown) of a keyword, or of eight hexadecimal digits, which an x may precede."""
    if name in ELEMENTS:
        tag, vr = ELEMENTS[name]
        return int(tag, 16), vr
    digits = name.lower().removeprefix("x")
    if len(digits) == 8 and all(c in "0123456789abcdef" for c in digits):
        known = [vr for tag, vr in ELEMENTS.values() if tag == digits.upper()]
        return int(digits, 16), known[0] if known else None
    raise ValueError(f"{name} is no keyword known here and no tag of eight hexadecimal digits")


def _little(value: Column, size: int) -> Column:
    """A whole number as bytes, the lowest first."""
    return bound(F.lpad(F.hex(value.cast("long")), 2 * size, "0"), lambda h: F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))))))


def _tag_bytes(tag: int) -> bytes:
    return bytes([tag >> 16 & 0xFF, tag >> 24, tag & 0xFF, tag >> 8 & 0xFF])


def element(name: str, value: Column, explicit: bool = True) -> Column:
    """One element as bytes: text padded to even length, US as two bytes, byte values as they are; nothing where the value is null."""
    tag, vr = tag_of(name)
    vr = vr or "UN"
    if vr == "US":
        data = _little(value, 2)
    elif vr in LONG:
        data = value
    else:
        data = bound(F.encode(value.cast("string"), "UTF-8"), lambda d: F.when(F.octet_length(d) % 2 == 1, F.concat(d, F.lit(b"\x00" if vr == "UI" else b" "))).otherwise(d))
    wide = not explicit or vr in LONG
    head = F.lit(_tag_bytes(tag) + (vr.encode() if explicit else b"") + (b"\x00\x00" if explicit and wide else b""))
    return bound(data, lambda d: F.when(d.isNotNull(), F.concat(head, _little(F.octet_length(d), 4 if wide else 2), d)).otherwise(F.lit(b"")))


def items(name: str, contents: list[Column], explicit: bool = True, stated_length: bool = True) -> Column:
    """A sequence of items, with stated lengths or with delimiters."""
    tag, _ = tag_of(name)
    open_ended = F.lit(b"\xff\xff\xff\xff")
    inner = []
    for c in contents:
        if stated_length:
            inner.append(bound(c, lambda d: F.concat(F.lit(b"\xfe\xff\x00\xe0"), _little(F.octet_length(d), 4), d)))
        else:
            inner += [F.lit(b"\xfe\xff\x00\xe0"), open_ended, c, F.lit(b"\xfe\xff\x0d\xe0\x00\x00\x00\x00")]
    data = F.concat(F.lit(b""), *inner, *([] if stated_length else [F.lit(b"\xfe\xff\xdd\xe0\x00\x00\x00\x00")]))
    head = F.lit(_tag_bytes(tag) + (b"SQ\x00\x00" if explicit else b""))
    return bound(data, lambda d: F.concat(head, _little(F.octet_length(d), 4), d)) if stated_length else F.concat(head, open_ended, data)


def file_bytes(class_uid: Column, instance_uid: Column, syntax: str, data_set: Column) -> Column:
    """A file: preamble, prefix, file meta information with its length, and the data set."""
    meta = F.concat(
        F.lit(b"\x02\x00\x01\x00OB\x00\x00\x02\x00\x00\x00\x00\x01"), element("MediaStorageSOPClassUID", class_uid), element("MediaStorageSOPInstanceUID", instance_uid), element("TransferSyntaxUID", F.lit(syntax))
    )
    return F.concat(F.lit(bytes(128) + b"DICM\x02\x00\x00\x00UL\x04\x00"), bound(meta, lambda m: F.concat(_little(F.octet_length(m), 4), m)), data_set)
