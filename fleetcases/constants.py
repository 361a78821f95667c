"""Values the results depend on, as the analysis states them. Every operator takes each of them
as a parameter with this default."""

from __future__ import annotations

# Fixed values, in the order the analysis uses them.
INSTALLED_STATUS = "Installed"            # assets kept for cases (compared ignoring case)
LOOKBACK_DAYS = 5                         # signal days counted before a case starts
SIGNAL_BIN_DAYS = 8                       # bins of the kept signal days (not the analysis's: any width from 6 on)
CASE_SPAN_DAYS = 32                       # spans a device's days are cut into where one key is hot (as above)
TOTAL_LABEL = "ALL_CASES"                 # label of the overall row in per-type reports
EXCLUDED_VERSION_PATTERNS = ("%nil%",)    # software versions that do not count as known
CASE_DEVICE_TYPE = "LMP"                  # device type of the per-SKU and reboot reports
BASE_PRODUCT = "Waiting Room Screen"      # installed base: product
BASE_STATUS = "Installed"                 # installed base: status (exact case)
LINUX_PLAYER = "LINUX_MEDIA_PLAYER"       # SKU type names counted separately in the totals
ANDROID_PLAYER = "ANDROID_MEDIA_PLAYER"
REBOOT_SCRIPT_ID = 112                    # the remote reboot script
DONE_STATUSES = ("acknowledged", "success")   # statuses of a finished run
REBOOT_TAG_PATTERN = "lmp_reboot%"        # tag names that mark a reboot
LINUX_PLAYER_TYPE = "LinuxMediaPlayer"    # application device type of the players
REPEAT_HORIZON_DAYS = 31                  # repeat window after a reboot
# TV maker from the profile bag name: the first LIKE pattern that matches gives the label
# (case-sensitive); no match keeps the raw name.
TV_MAKER_RULES: tuple[tuple[str, str], ...] = (
    ("%LG%", "LG"),
    ("%Samsung%", "Samsung"),
    ("%Phillips%", "Philips"),
    ("%Philips%", "Philips"),
    ("%ChiMei%", "ChiMei"),
    ("%Sony Black%", "Sony Black"),
    ("%Sony Silver%", "Sony Silver"),
    ("%Polaroid%", "Polaroid"),
    ("%Prima%", "Prima"),
    ("%Fransican%", "Samsung"),
)
