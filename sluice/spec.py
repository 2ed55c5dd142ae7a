"""What a data set's columns are for."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class DatasetSpec:
    name: str
    categorical: tuple[str, ...]
    binary: tuple[str, ...]
    continuous: tuple[str, ...]
    label: str = "Label"
    dropped: tuple[str, ...] = ()
    one_hot: tuple[str, ...] = ()
    ports: tuple[str, ...] = ()
    majority: tuple[str, ...] = ()
    minority: tuple[str, ...] = ()
    families: tuple[tuple[str, tuple[str, ...]], ...] = ()
    other_family: str = "Benign"
    raw: tuple[str, ...] = ()
    strict: bool = False

    @property
    def ordered(self) -> tuple[str, ...]:
        """A model's inputs in their order."""
        return self.categorical + self.binary + self.continuous

    @property
    def numerical(self) -> tuple[str, ...]:
        """What the numerical encoders scale."""
        return self.ports + self.continuous

    @property
    def labels(self) -> tuple[str, ...]:
        return self.majority + self.minority

    def family_map(self) -> dict[str, str]:
        return {name: family for family, names in self.families for name in names}


# Column names, labels and attack names as the two public data sets' files and configurations have them.
FLOWS = DatasetSpec(
    name="cic2018",
    categorical=("Dst Port",),
    binary=("RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "ECE Flag Cnt"),
    continuous=(
        "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
        "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std", "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
        "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
        "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s", "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var", "Down/Up Ratio", "Pkt Size Avg",
        "Fwd Seg Size Avg", "Bwd Seg Size Avg", "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts", "Init Fwd Win Byts", "Fwd Act Data Pkts",
        "Fwd Seg Size Min", "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
    ),
    dropped=(
        "Timestamp", "Bwd PSH Flags", "Bwd URG Flags", "Fwd Byts/b Avg", "Fwd Pkts/b Avg", "Fwd Blk Rate Avg", "Bwd Byts/b Avg", "Bwd Pkts/b Avg", "Bwd Blk Rate Avg",
        "Fwd PSH Flags", "Fwd URG Flags", "FIN Flag Cnt", "SYN Flag Cnt", "URG Flag Cnt", "CWE Flag Count", "Init Bwd Win Byts", "Protocol",
    ),
    ports=("Dst Port",),
    majority=("Benign", "DDoS attacks-LOIC-HTTP", "DDOS attack-HOIC", "DoS attacks-Hulk", "Bot", "Infilteration", "SSH-Bruteforce", "DoS attacks-GoldenEye"),
    minority=("DoS attacks-Slowloris", "Brute Force -Web", "Brute Force -XSS", "SQL Injection"),
)
CONNECTIONS = DatasetSpec(
    name="nslkdd",
    categorical=("protocol_type", "service", "flag"),
    binary=("land", "logged_in", "is_host_login", "is_guest_login"),
    continuous=(
        "duration", "src_bytes", "dst_bytes", "wrong_fragment", "urgent", "hot", "num_failed_logins", "num_compromised", "root_shell", "su_attempted", "num_root",
        "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
        "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
        "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    ),
    one_hot=("protocol_type", "service", "flag"),
    majority=("Benign", "DoS"),
    minority=("Probe", "R2L", "U2R"),
    families=(
        ("DoS", ("apache2", "back", "land", "neptune", "mailbomb", "pod", "processtable", "smurf", "teardrop", "udpstorm", "worm")),
        ("Probe", ("ipsweep", "mscan", "nmap", "portsweep", "saint", "satan")),
        ("U2R", ("buffer_overflow", "loadmdoule", "perl", "ps", "rootkit", "sqlattack", "xterm")),
        ("R2L", ("ftp_write", "guess_passwd", "http_tunnel", "imap", "multihop", "named", "phf", "sendmail", "snmpgetattack", "snmpguess", "spy", "warezclient", "warezmaster", "xclock", "xsnoop")),
    ),
    raw=(
        "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
        "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count",
        "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
        "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
        "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "attack", "level",
    ),
    strict=True,
)
SPECS = {s.name: s for s in (FLOWS, CONNECTIONS)}
