"""Taps of the gait band filter for signals at 40 Hz."""

import numpy as np

RATE_HZ = 40

#: The filter's impulse response.
TAPS = np.array(
    """
-7.32062354912454e-05 3.78508622436883e-05 0.000246348109197937 0.000677903580565397 0.00139121173834152
0.00240120107902306 0.00365134729205267 0.00499791461345996 0.00621524709266542 0.00702710179358570
0.00716251647666459 0.00642763923506909 0.00477644184660929 0.00235955274741389 -0.000467004701949172
-0.00318729268148899 -0.00522215422251725 -0.00606335356628703 -0.00541421442262487 -0.00330024440090518
-0.000113511367820591 0.00343303842402714 0.00644432500038348 0.00805222780827783 0.00764951215205984
0.00508854384693732 0.000785246955265535 -0.00431394654940573 -0.00891383397938441 -0.0116725408042536
-0.0115599416061123 -0.00818324078638784 -0.00198780208134589 0.00573815422238463 0.0130835533924908
0.0179324660414459 0.0184981068429205 0.0138510767938709 0.00430688629153999 -0.00844188778061492
-0.0215122304374164 -0.0313277564810650 -0.0343411216793298 -0.0278350948468902 -0.0106240721245163
0.0165123088037780 0.0507816763239513 0.0877543665066161 0.122104791742143 0.148576643831182
0.162974796835057 0.162974796835057 0.148576643831182 0.122104791742143 0.0877543665066161
0.0507816763239513 0.0165123088037780 -0.0106240721245163 -0.0278350948468902 -0.0343411216793298
-0.0313277564810650 -0.0215122304374164 -0.00844188778061492 0.00430688629153999 0.0138510767938709
0.0184981068429205 0.0179324660414459 0.0130835533924908 0.00573815422238463 -0.00198780208134589
-0.00818324078638784 -0.0115599416061123 -0.0116725408042536 -0.00891383397938441 -0.00431394654940573
0.000785246955265535 0.00508854384693732 0.00764951215205984 0.00805222780827783 0.00644432500038348
0.00343303842402714 -0.000113511367820591 -0.00330024440090518 -0.00541421442262487 -0.00606335356628703
-0.00522215422251725 -0.00318729268148899 -0.000467004701949172 0.00235955274741389 0.00477644184660929
0.00642763923506909 0.00716251647666459 0.00702710179358570 0.00621524709266542 0.00499791461345996
0.00365134729205267 0.00240120107902306 0.00139121173834152 0.000677903580565397 0.000246348109197937
3.78508622436883e-05 -7.32062354912454e-05
""".split(),
    float,
)
