"""Tag lists of the de-identification standard's confidentiality profile, fixed values."""

from __future__ import annotations

#: Dates and times that stay: context group and template versions and product expiration.
KEPT_DATES = ["00080106", "00080107", "0040DB06", "0040DB07", "0044000B"]
#: Identifiers of the de-identification standard. SOP class tags are in none, a class shared by files is no identity.
UID_TAGS = [
    "00020003", "00041511", "00080014", "00080018", "0008010D", "00081155", "00081195", "00083010", "00181002", "00182042", "0020000D", "0020000E", "00200052", "00200200",
    "00209161", "00209164", "00281199", "00281214", "003A0310", "00400554", "00404023", "0040A124", "0040A171", "0040A172", "0040A402", "0040DB0C", "0040DB0D", "00620021",
    "0070031A", "00701101", "00701102", "00880140", "04000100", "30060024", "300600C2", "300A0013", "300A0083", "300A0609", "300A0650", "300A0700", "30100006", "3010000B",
    "30100013", "30100015", "30100031", "3010003B", "3010006E", "3010006F",
]
#: Ids of patients, trials, admissions and orders.
ID_TAGS = [
    "00100020", "00120020", "00120040", "00120042", "00200010", "00340002", "00380010", "00400512", "00400551", "00401001", "0040A027",
]
#: Person names, whatever representation a file gives them.
NAME_TAGS = ["00080090", "0008009C", "0008A075", "00081070", "00100010", "00120010", "0040A123", "00700084", "300600A6", "300E0008"]
#: Dates, times and stamps with their representations, for files that give none.
DATE_TAGS = dict.fromkeys(
    [
        "00080020", "00080021", "00080022", "00080023", "00080024", "00080025", "0016008D", "00100030", "001021D0", "00380020", "00400002", "00400004", "00400244", "00400250",
        "0040A192", "30060008", "30080054", "30080056", "30080250", "3010004C", "3010004D", "300A0006",
    ],
    "DA",
) | dict.fromkeys(
    ["00080030", "00080031", "00080032", "00080033", "00080034", "00080035", "00100032", "00380021", "00400003", "00400005", "00400245", "00400251", "0040A193", "30060009", "30080251", "300A0007"], "TM"
) | dict.fromkeys(
    [
        "00080015", "0008002A", "00189369", "0018936A", "00189516", "00189517", "003A0314", "00400008", "00400010", "00404005", "00404011", "00404050", "00404051", "00404052",
        "300A0736", "300A073A", "300A0741", "300A0760",
    ],
    "DT",
)
#: The survey's profile, fixed values of the de-identification standard; callers may pass their own, of any size, as {action: [tags]}.
PROFILE = {
    "remove": [
        "00080058", "00080092", "00080094", "00080096", "0008009D", "00081048", "00081049", "00081050", "00081052", "00081060", "00081062", "00081072", "00081120", "00100021",
        "00100032", "00100050", "00100101", "00100102", "00101000", "00101001", "00101002", "00101005", "00101040", "00101050", "00101060", "00101080", "00101081", "00101090",
        "00101100", "00102000", "00102150", "00102152", "00102154", "00102155", "00102160", "00102180", "001021B0", "001021F0", "00102297", "00102299", "00104000", "00120021",
        "00120071", "00120082", "0016004D", "00160070", "00160071", "00160072", "00160073", "00160074", "00160075", "00160076", "00160077", "00160078", "00160079", "0016007A",
        "0016007B", "0016007C", "0016007D", "0016007E", "0016007F", "00160080", "00160081", "00160082", "00160083", "00160084", "00160085", "00160086", "00160087", "00160088",
        "00160089", "0016008A", "0016008B", "0016008C", "0016008E", "00203401", "00203406", "00284000", "00320012", "00321032", "00321033", "00380004", "00380010", "00380011",
        "00380014", "0038001E", "00380060", "00380061", "00380064", "00380300", "00380400", "00380500", "00400006", "00400007", "00400009", "0040000B", "00400243", "00400253",
        "00400254", "00400280", "0040050A", "004006FA", "00401001", "00401004", "00401005", "00401010", "00401011", "00401102", "00401103", "00401104", "00402008", "00402009",
        "00402010", "00402011", "00403001", "00404034", "00404035", "00404036", "00404037", "0040A078", "0040A07A", "0040A07C", "0040A307", "0040A352", "0040A353", "0040A354",
        "0040A358", "0050001B", "00700086", "00880200", "00880904", "00880906", "00880910", "00880912", "04000402", "04000403", "04000404", "04000550", "04000551", "04000552",
        "04000561", "04000600", "20300020", "40000010", "40004000", "40080042", "40080102", "4008010A", "4008010C", "40080111", "40080114", "40080118", "40080119", "4008011A",
        "40080202", "40080300", "FFFAFFFA", "FFFCFFFC",
    ],
    "description_remove": [
        "00081030", "0008103E", "00081080", "00081084", "00082111", "00084000", "00102180", "001021B0", "00104000", "00120051", "00120072", "0016002B", "0016004B", "00181030",
        "00181400", "00184000", "00189185", "0018937B", "0018937F", "00189424", "0018A003", "00204000", "00209158", "00321030", "00321060", "00321066", "00321067", "00321070",
        "00324000", "00380040", "00380062", "00380500", "00384000", "00400275", "00400280", "00400310", "00400600", "00400602", "00401002", "0040100A", "00401400", "00402001",
        "00402400", "00500021", "30060004", "30060006", "30060028", "30060038", "300A0003", "300A0004", "300A000E", "300A0016", "300A0072", "300A00C3", "300A00DD", "300A0196",
        "300A01A6", "300A01B2", "300A02EB", "300A0676", "300C0113", "30100036", "30100037", "30100056", "30100061", "30100081", "4008010B", "40080115", "40084000",
    ],
    "device_remove": [
        "0016004E", "0016004F", "00160050", "00160051", "00181000", "00181002", "00181004", "00181005", "00181007", "00181008", "00181009", "0018100A", "0018100B", "00185011",
        "00189373", "00321020", "00321021", "00400001", "00400010", "00400011", "00400241", "00400242", "00404025", "00404027", "00404028", "00404030", "00500020", "300A0216",
    ],
    "institution_remove": ["00080080", "00080081", "00080082", "00081040", "00081041", "00081050"],
    "patient_remove": [
        "00101000", "00101010", "00101020", "00101030", "00102110", "00102160", "001021A0", "001021C0", "00380050", "00400012",
    ],
    "empty": [
        "00080050", "00080090", "00100030", "00100040", "00120050", "00200010", "00340005", "00402016", "00402017", "22000005", "3010001B",
    ],
    "description_empty": [
        "00081030", "0008103E", "00180010", "0040051A", "22000002", "30060026", "30060085", "30060088", "300A0611", "300A0615", "300A067D", "3010000F", "30100017", "3010005A",
        "3010005C", "3010007A", "3010007B", "3010007F",
    ],
    "device_empty": ["00081010", "30080105", "300A00B2", "30100043"],
    "institution_empty": ["00080080", "00120030", "00120031", "00120060"],
    "patient_empty": ["00100040", "00102203"],
    "description_replace": [
        "001811BB", "30060002", "300A0002", "300A0608", "300A0619", "300A0623", "300A062A", "300A067C", "300A0734", "300A0741", "300A0783", "30100033", "30100034", "30100035",
        "30100038", "30100054", "30100077",
    ],
    "device_replace": ["00181000", "0018700A", "00189367", "00189371", "3010002D"],
    "institution_replace": ["00120081"],
    "zero": ["00400513", "00400555", "00400562", "0040A088"],
    "structured_zero": ["00400555", "00400610", "0040A730"],
}
