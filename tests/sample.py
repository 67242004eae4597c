"""One day at an invented freight yard: logins, two attacks on passwords, a stolen account, and host, firewall, web and
endpoint logs. What the engine must make of it is worked out by hand in ``test_pipeline.py``."""

DAY = "2026-03-04"


def _sshd(clock, host, text, source):
    return f"Mar  4 {clock} {host} sshd[{700 + int(clock[-2:])}]: {text} from {source} port 50222 ssh2"


def _clock(hour, minute=0, second=0):
    return f"{hour:02d}:{minute:02d}:{second:02d}"


def logins():
    crew = (("ines", "10.20.0.1"), ("tomas", "10.20.0.2"), ("ruth", "10.20.0.3"))
    for turn in range(12):
        name, source = crew[turn % 3]
        yield _sshd(_clock(9 + turn // 6, turn % 6 * 10), ("dock-7", "ledger-1")[turn % 2], f"Accepted publickey for {name}", source)


def guessing():
    for second in range(0, 70, 10):
        yield _sshd(_clock(11, 0, second) if second < 60 else _clock(11, 1, 0), "ledger-1", "Failed password for deploy", "91.198.174.5")
    yield _sshd(_clock(11, 2), "ledger-1", "Accepted password for deploy", "91.198.174.5")


def spraying():
    for n, name in enumerate(("olga", "piet", "quin", "rosa", "sven", "tara")):
        yield _sshd(_clock(12, 0, 5 * n), "dock-7", f"Failed password for invalid user {name}", "10.20.9.9")


def odd_logins():
    yield _sshd(_clock(5, 30), "gate-a", "Accepted password for admin", "10.20.0.50")
    for n, source in enumerate(("10.20.1.1", "10.20.1.2", "10.20.1.3", "91.198.174.77", "93.184.216.34")):
        yield _sshd(_clock(13, 10 * n), "gate-a", "Accepted password for kofi", source)


def hosts():
    def line(clock, host, number, process, command, text):
        return f'WinEvent Time={DAY}T{clock}Z Host={host} EventID={number} User=lian Process={process} CommandLine="{command}" Message="{text}"'

    yield line("14:00:00", "desk-3", 4104, "powershell.exe", "powershell -enc QQBC", "script block")
    yield line("14:01:00", "desk-3", 4688, "notepad.exe", "notepad freight.txt", "started")
    yield line("14:10:00", "dir-1", 4720, "mmc.exe", "mmc", "account created")
    yield line("14:12:00", "dir-1", 4732, "mmc.exe", "mmc", "member added")
    yield line("14:30:00", "dir-1", 4732, "mmc.exe", "mmc", "member added")


def network():
    def line(clock, action, source, target, port):
        return f'{DAY}T{clock}Z yard-fw FW action={action} src={source} dst={target} dpt={port} proto=UDP msg="rule {port}"'

    for n in range(9):
        yield line(_clock(15, 0, 2 * n), "DENY", "10.20.5.5", f"10.30.0.{n + 1}", 139)
    for n in range(4):
        yield line(_clock(15, 30 + n), "ALLOW", f"10.20.6.{n}", "10.30.1.1", 8443)


def web():
    for clock, source, path in ((_clock(16), "10.20.7.1", "/berths"), (_clock(16, 0, 30), "10.20.7.2", "/berths/4"),
                                (_clock(16, 20), "10.20.7.1", "/plan?file=../../keys")):
        yield f'{source} - - [04/Mar/2026:{clock} +0000] "GET {path} HTTP/1.1" 200 88 "yard-kiosk"'


def endpoints():
    for n, (process, command) in enumerate((("calc.exe", "calc"), ("sh.exe", "iex DownloadString u"))):
        yield {"id": f"edr-{n}", "timestamp": f"{DAY}T17:0{5 * n}:00+00:00", "source": "edr", "event_type": "process_start", "asset": "desk-3",
               "user": "lian", "process_name": process, "command_line": command, "status": "success", "raw_log": f"edr {n}"}


def sample_items():
    scenes = (network, endpoints, logins, web, spraying, hosts, guessing, odd_logins)
    return [item for scene in scenes for item in scene()]
